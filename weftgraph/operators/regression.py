"""Query results before and after a change, held against each other by nine modes.

A DataFrame has no order of its own, so the caller names the columns that order both results.
Rows get their places from a range partitioning and the partitions' sizes: no task sees all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from weftgraph.functions.keys import fingerprint
from weftgraph.functions.lineage import cut
from weftgraph.functions.numbers import moved_by, within
from weftgraph.operators.compare import bag_difference

#: Fixed values.
MODES = ["EXACT", "NUMERIC_TOLERANCE", "PRESERVE_AGGREGATE", "EXPECTED_DELTA", "EXPECTED_VALUE", "EXPECTED_CHANGE", "SET_EQUIVALENCE", "SCHEMA_ONLY", "MONITOR"]
BOUNDED = ["EXACT", "NUMERIC_TOLERANCE", "SET_EQUIVALENCE"]
RESULT = "mode string, status string, changed boolean, rows_before long, rows_after long, cells_failed long, codes array<string>, before_hash string, after_hash string"
_HEX = 14  #: digits of a row's digest that are summed


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``place`` from 1 by ``order``, which should be unique; nulls come first."""
    sorted_rows = rows.select(F.struct(F.col("*")).alias("row")).repartitionByRange(*[F.col(f"row.{c}") for c in order]).sortWithinPartitions(*[F.col(f"row.{c}") for c in order])
    numbered = cut(sorted_rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return numbered.withColumn("part", part).join(F.broadcast(before), "part").select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("place"), "row")


def content_hash(rows: DataFrame) -> Column:
    """Aggregate over (place, row): a digest of names, types, rows and their order. Row digests are added up, so partial sums do."""
    fields = rows.schema["row"].dataType
    text = fingerprint(F.col("place"), *[F.col("row")[n] for n in fields.names])
    total = F.sum(F.conv(F.substring(text, 1, _HEX), 16, 10).cast("decimal(20,0)"))
    head = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)
    return F.sha2(F.concat_ws("|", F.lit(head), F.count("*").cast("string"), F.coalesce(total.cast("string"), F.lit("0"))), 256)


def _same(kind, x: Column, y: Column, mode: str, fold: bool, limits: dict) -> Column:
    if mode != "EXACT" and isinstance(kind, NumericType):
        if mode == "EXPECTED_DELTA":
            return moved_by(x, y, kind, limits["least"], limits["most"])
        return within(x, y, kind, limits["absolute"], limits["relative"])
    if fold and isinstance(kind, StringType):
        return F.lower(x).eqNullSafe(F.lower(y))
    return x.eqNullSafe(y)


def _cells(a: DataFrame, b: DataFrame, mode: str, fold: bool, limits: dict) -> int:
    """How many cells at equal places differ by ``mode``."""
    fields = a.schema["row"].dataType
    both = a.select("place", F.col("row").alias("x")).join(b.select("place", F.col("row").alias("y")), "place")
    wrong = reduce(lambda p, q: p + q, [(~_same(f.dataType, F.col("x")[f.name], F.col("y")[f.name], mode, fold, limits)).cast("int") for f in fields])
    return both.agg(F.sum(wrong)).first()[0] or 0


@dataclass(frozen=True)
class Side:
    """A result with its rows in place, their number and their digest, for use in several comparisons."""

    frame: DataFrame
    rows: DataFrame
    n: int
    hash: str


def side(frame: DataFrame, order: list[str]) -> Side:
    rows = placed(frame, order)
    told = rows.agg(F.count("*").alias("n"), content_hash(rows).alias("h")).first()
    return Side(frame, rows, told["n"], told["h"])


def regression(before: DataFrame | Side, after: DataFrame | Side, mode: str, order: list[str], missing: bool = False, new: bool = False, expected: DataFrame | Side | None = None, how: str = "EXACT", fold: bool = False, absolute: float = 0.0, relative: float = 0.0, least: float | None = None, most: float | None = None) -> DataFrame:
    """One row: mode, status, changed, rows_before, rows_after, cells_failed, codes, before_hash, after_hash.

    Columns must agree in name and type, and fewer or more rows fail unless ``missing`` or ``new`` allow them, in every
    mode but MONITOR, which is INCONCLUSIVE always. EXACT, NUMERIC_TOLERANCE, PRESERVE_AGGREGATE (one row a side) and
    EXPECTED_DELTA compare cells by place, and any other number of rows fails them; SET_EQUIVALENCE compares bags of rows;
    EXPECTED_VALUE and EXPECTED_CHANGE hold ``after`` against ``expected`` by mode ``how``. ``fold`` ignores the case of
    texts. Null equals null alone. Numbers differ as decimals of their shortest text, limits too, where 28 digits hold them.
    A cell that is no number is compared exactly in every mode. A result that is compared more than once may be given as a ``side``,
    which is placed once.
    """
    if mode not in MODES or how not in BOUNDED:
        raise ValueError(f"no such mode: {mode}, {how}")
    if min(absolute, relative) < 0 or mode == "EXPECTED_DELTA" and (least is None or most is None or least > most):
        raise ValueError("tolerances must not be negative, and least at most most")
    x, y = (s if isinstance(s, Side) else side(s, order) for s in (before, after))
    before, after, a, b = x.frame, y.frame, x.rows, y.rows
    spark, limits = before.sparkSession, {"absolute": absolute, "relative": relative, "least": least, "most": most}
    same = [(f.name, f.dataType) for f in before.schema] == [(f.name, f.dataType) for f in after.schema]
    row = [mode, "", x.hash != y.hash, x.n, y.n, 0, [], x.hash, y.hash]
    if mode == "MONITOR":
        row[1], row[6] = "INCONCLUSIVE", ["MONITOR_REQUIRES_ACCEPTANCE"]
        return spark.createDataFrame([tuple(row)], RESULT)
    codes = set() if same else {"COLUMN_SCHEMA_CHANGED"}
    codes |= {"MISSING_ROWS"} if x.n > y.n and not missing else set()
    codes |= {"ADDITIONAL_ROWS"} if x.n < y.n and not new else set()
    if mode == "SET_EQUIVALENCE":
        codes |= {"ROW_SET_CHANGED"} if not same or not bag_difference(before, after).isEmpty() else set()
    elif mode in ("EXPECTED_VALUE", "EXPECTED_CHANGE"):
        if expected is None:
            codes.add("EXPECTED_RESULT_MISSING")
        else:
            inner = regression(expected, y, how, order, absolute=absolute, relative=relative).first()
            codes |= set(inner["codes"])
            row[5] = inner["cells_failed"]
    elif mode != "SCHEMA_ONLY":
        codes |= {"ROW_COUNT_CHANGED"} if x.n != y.n else set()
        row[5] = _cells(a, b, mode, fold, limits) if same else 0
        codes |= {"CELL_CHANGED"} if row[5] else set()
        if mode == "PRESERVE_AGGREGATE" and (x.n, y.n) != (1, 1):
            codes.add("AGGREGATE_QUERY_MUST_RETURN_ONE_ROW")
    row[1], row[6] = "FAILED" if codes else "PASSED", sorted(codes)
    return spark.createDataFrame([tuple(row)], RESULT)


def covered(verdicts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(status, passed, failed, inconclusive, covered, uncovered) of all ``verdicts`` (object_id, status) for the ``wanted`` (object_id).

    An object is covered if some verdict on it passed or failed; objects without one leave the sum INCONCLUSIVE.
    """
    of = lambda s: F.count_if(F.col("status") == s)
    counts = verdicts.agg(of("PASSED").alias("passed"), of("FAILED").alias("failed"), of("INCONCLUSIVE").alias("inconclusive"))
    decided = verdicts.where("status IN ('PASSED', 'FAILED')").select("object_id").distinct().withColumn("seen", F.lit(1))
    seen = wanted.select("object_id").distinct().join(decided, "object_id", "left").agg(F.count("seen").alias("covered"), F.count_if(F.col("seen").isNull()).alias("uncovered"))
    both = counts.withColumn("k", F.lit(1)).join(seen.withColumn("k", F.lit(1)), "k")
    status = F.when(F.col("failed") > 0, "FAILED").when((F.col("inconclusive") > 0) | (F.col("uncovered") > 0), "INCONCLUSIVE").otherwise("PASSED")
    return both.select(status.alias("status"), "passed", "failed", "inconclusive", "covered", "uncovered")
