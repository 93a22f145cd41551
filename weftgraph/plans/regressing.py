"""Result regression by every mode, positions and coverage; registers with ``queries``."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.numbers import moved_by, within
from weftgraph.operators.regression import covered, placed, regression, side
from weftgraph.plans.queries import query
from weftgraph.sources.star import table

_SIDES = """a AS (SELECT o_custkey AS k, count(*)::DOUBLE AS v, min(o_orderstatus) AS s FROM orders GROUP BY 1),
  b AS (SELECT k, CASE WHEN k % 10 = 0 THEN v + 1 ELSE v END AS v, CASE WHEN k % 15 = 0 THEN lower(s) ELSE s END AS s FROM a),
  c AS (SELECT * FROM b WHERE k % 4 <> 1)"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("k")
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("v"), F.min("o_orderstatus").alias("s"))
    b = a.select("k", F.when(k % 10 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"), F.when(k % 15 == 0, F.lower("s")).otherwise(F.col("s")).alias("s"))
    return a, b, b.where(k % 4 != 1)


def _cells(x: str, y: str, wrong: str) -> str:
    """Cells at equal places of two tables for which ``wrong``, over p and q, counts."""
    side = lambda t: f"(SELECT *, row_number() OVER (ORDER BY k) AS place FROM {t})"
    return f"(SELECT coalesce(sum({wrong}), 0) FROM {side(x)} p JOIN {side(y)} q USING (place))"


def _case(mode: str, label: str, y: str, codes: dict[str, str], cells: str = "0") -> str:
    """A row whose codes are the names of the conditions that hold, in order of name."""
    listed = ", ".join(f"CASE WHEN {when} THEN '{code}' END" for code, when in sorted(codes.items()))
    n = lambda t: f"(SELECT count(*) FROM {t})"
    return f"""SELECT '{label}' AS label, '{mode}' AS mode, array_to_string(list_filter([{listed or 'NULL'}]::VARCHAR[], lambda c: c IS NOT NULL), ',') AS codes,
      ({cells})::BIGINT AS cells_failed, {n('a')} AS rows_before, {n(y)} AS rows_after"""


_EQ = "(p.k IS DISTINCT FROM q.k)::INT + (p.v IS DISTINCT FROM q.v)::INT + (p.s IS DISTINCT FROM q.s)::INT"
_NEAR = "(abs(q.k - p.k) > {tol})::INT + (abs(q.v - p.v) > {tol})::INT + (p.s IS DISTINCT FROM q.s)::INT"
_FOLD = "(p.k IS DISTINCT FROM q.k)::INT + (p.v IS DISTINCT FROM q.v)::INT + (lower(p.s) IS DISTINCT FROM lower(q.s))::INT"
_LOST = "(SELECT count(*) FROM a) > (SELECT count(*) FROM c)"
_CASES = [
    _case("EXACT", "same", "a", {}),
    _case("EXACT", "changed", "b", {"CELL_CHANGED": f"{_cells('a', 'b', _EQ)} > 0"}, _cells("a", "b", _EQ)),
    _case("EXACT", "folded", "b", {"CELL_CHANGED": f"{_cells('a', 'b', _FOLD)} > 0"}, _cells("a", "b", _FOLD)),
    _case("EXACT", "lost", "c", {"MISSING_ROWS": _LOST, "ROW_COUNT_CHANGED": _LOST, "CELL_CHANGED": f"{_cells('a', 'c', _EQ)} > 0"}, _cells("a", "c", _EQ)),
    _case("NUMERIC_TOLERANCE", "within one", "b", {"CELL_CHANGED": f"{_cells('a', 'b', _NEAR.format(tol=1))} > 0"}, _cells("a", "b", _NEAR.format(tol=1))),
    _case("EXPECTED_DELTA", "minus one to zero", "b", {"CELL_CHANGED": f"{_cells('a', 'b', '(q.k - p.k NOT BETWEEN -1 AND 0)::INT + (q.v - p.v NOT BETWEEN -1 AND 0)::INT + (p.s IS DISTINCT FROM q.s)::INT')} > 0"},
          _cells("a", "b", "(q.k - p.k NOT BETWEEN -1 AND 0)::INT + (q.v - p.v NOT BETWEEN -1 AND 0)::INT + (p.s IS DISTINCT FROM q.s)::INT")),
    _case("SET_EQUIVALENCE", "bags", "b", {"ROW_SET_CHANGED": "(SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) > 0"}),
    _case("SCHEMA_ONLY", "lost", "c", {"MISSING_ROWS": _LOST}),
    _case("SCHEMA_ONLY", "lost, allowed", "c", {}),
    _case("PRESERVE_AGGREGATE", "many rows", "b", {"AGGREGATE_QUERY_MUST_RETURN_ONE_ROW": "true", "CELL_CHANGED": f"{_cells('a', 'b', _NEAR.format(tol=1))} > 0"}, _cells("a", "b", _NEAR.format(tol=1))),
    _case("EXPECTED_VALUE", "as expected", "b", {}),
    _case("EXPECTED_CHANGE", "not as expected", "c", {"MISSING_ROWS": _LOST, "ROW_COUNT_CHANGED": _LOST, "CELL_CHANGED": f"{_cells('b', 'c', _EQ)} > 0"}, _cells("b", "c", _EQ)),
    _case("EXPECTED_VALUE", "none given", "b", {"EXPECTED_RESULT_MISSING": "true"}),
    _case("MONITOR", "watched", "b", {"MONITOR_REQUIRES_ACCEPTANCE": "true"}),
]


@query(f"WITH {_SIDES}, t AS ({' UNION ALL '.join(_CASES)}) SELECT label, mode, CASE WHEN mode = 'MONITOR' THEN 'INCONCLUSIVE' WHEN codes = '' THEN 'PASSED' ELSE 'FAILED' END AS status, label <> 'same' AS changed, rows_before, rows_after, cells_failed, codes FROM t")
def regression_modes(spark, d) -> DataFrame:
    a, b, c = (side(df, ["k"]) for df in _sides(spark, d))
    one = lambda label, y, mode, **kw: regression(a, y, mode, ["k"], **kw).withColumn("label", F.lit(label))
    rows = [
        one("same", a, "EXACT"), one("changed", b, "EXACT"), one("folded", b, "EXACT", fold=True), one("lost", c, "EXACT"), one("within one", b, "NUMERIC_TOLERANCE", absolute=1.0),
        one("minus one to zero", b, "EXPECTED_DELTA", least=-1.0, most=0.0), one("bags", b, "SET_EQUIVALENCE"), one("lost", c, "SCHEMA_ONLY"), one("lost, allowed", c, "SCHEMA_ONLY", missing=True),
        one("many rows", b, "PRESERVE_AGGREGATE", absolute=1.0), one("as expected", b, "EXPECTED_VALUE", expected=b), one("not as expected", c, "EXPECTED_CHANGE", expected=b),
        one("none given", b, "EXPECTED_VALUE"), one("watched", b, "MONITOR"),
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("codes", F.array_join("codes", ",")).drop("before_hash", "after_hash")


_EDGE = """t AS (SELECT l_orderkey * 8 + l_linenumber AS k, round(l_extendedprice, 2)::DECIMAL(18,2) AS v FROM lineitem),
  pairs AS (SELECT k, v, v + CASE k % 4 WHEN 0 THEN 0.10 WHEN 1 THEN -0.10 WHEN 2 THEN 0.11 ELSE 0.09 END::DECIMAL(18,2) AS w FROM t)"""


@query(f"""WITH {_EDGE} SELECT k, abs(w - v) <= 0.10 AS absolute, abs(w - v) <= 0.00001::DECIMAL(6,5) * greatest(abs(v), abs(w)) AS relative, w - v BETWEEN -0.10 AND 0.09 AS moved FROM pairs""")
def decimal_tolerance(spark, d) -> DataFrame:
    """Prices a tenth apart as floats, of which binary subtraction makes a little more or less than a tenth."""
    k, v = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.round("l_extendedprice", 2).cast("decimal(18,2)")
    by = F.element_at(F.array(*[F.lit(Decimal(x)) for x in ("0.10", "-0.10", "0.11", "0.09")]), (F.col("k") % 4 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(k.alias("k"), v.alias("v")).select("k", F.col("v").cast("double").alias("x"), (F.col("v") + by).cast("double").alias("y"))
    x, y, kind = F.col("x"), F.col("y"), rows.schema["x"].dataType
    return rows.select("k", within(x, y, kind, 0.1).alias("absolute"), within(x, y, kind, relative=0.00001).alias("relative"), moved_by(x, y, kind, -0.1, 0.09).alias("moved"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place, o_orderkey FROM orders")
def places(spark, d) -> DataFrame:
    """Every row's place in an explicit order, without a task that sees them all."""
    return placed(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]).select("place", "row.o_orderkey")


@query("""WITH v AS (SELECT DISTINCT o_custkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'INCONCLUSIVE' ELSE 'PASSED' END AS status FROM orders),
  d AS (SELECT DISTINCT id FROM v WHERE status = 'PASSED'), w AS (SELECT c_custkey IN (SELECT id FROM d) AS seen FROM customer)
  SELECT 'INCONCLUSIVE' AS status, (SELECT count(*) FROM v WHERE status = 'PASSED') AS passed, 0 AS failed, (SELECT count(*) FROM v WHERE status = 'INCONCLUSIVE') AS inconclusive,
    (SELECT count(*) FROM w WHERE seen) AS covered, (SELECT count(*) FROM w WHERE NOT seen) AS uncovered""")
def regression_coverage(spark, d) -> DataFrame:
    verdicts = table(spark, d, "orders").select(F.col("o_custkey").alias("object_id"), F.when(F.col("o_orderstatus") == "P", "INCONCLUSIVE").otherwise("PASSED").alias("status")).distinct()
    return covered(verdicts, table(spark, d, "customer").select(F.col("c_custkey").alias("object_id")))
