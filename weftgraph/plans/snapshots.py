"""Alignment, deep differences, verdicts, search and stream queries; registers with ``queries``."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import shared_folder
from weftgraph.operators import align, search
from weftgraph.plans.queries import query
from weftgraph.sources.metadata import card_lines
from weftgraph.sources.star import GRAPH_SQL, edges, nodes, table
from weftgraph.streaming import changes, rescans

_SIDES_SQL = """a AS (SELECT p_partkey AS id, p_type AS kind, p_brand AS tab, p_name || ' ' || p_partkey AS name, p_size AS sig FROM part),
  b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'OTHER' ELSE p_type END AS kind, CASE WHEN p_partkey % 7 = 0 THEN 'moved' ELSE p_brand END AS tab,
    CASE WHEN p_partkey % 5 = 0 THEN 'New ' || p_partkey ELSE p_name || ' ' || p_partkey END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS sig FROM part WHERE p_partkey % 13 <> 0)"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    k, p = F.col("p_partkey"), table(spark, d, "part")
    named = F.concat("p_name", F.lit(" "), k.cast("string"))
    tag = F.when(k % 2 == 0, F.concat(F.lit("tag"), k.cast("string"))).alias("tag")
    left = p.select(k.alias("id"), F.col("p_type").alias("kind"), tag, F.col("p_brand").alias("table"), named.alias("name"), F.col("p_size").alias("signature"))
    right = p.where(k % 13 != 0).select(
        k.alias("id"), F.when(k % 11 == 0, "OTHER").otherwise(F.col("p_type")).alias("kind"), tag, F.when(k % 7 == 0, "moved").otherwise(F.col("p_brand")).alias("table"),
        F.when(k % 5 == 0, F.concat(F.lit("New "), k.cast("string"))).otherwise(named).alias("name"), F.when(k % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("signature"),
    )
    return left, right


_MATCHED = "a.id % 2 = 0 OR a.name = b.name AND (a.kind = b.kind OR a.tab = b.tab)"
_STEP = "CASE WHEN a.id % 2 = 0 THEN 'tag' WHEN a.kind = b.kind AND a.tab = b.tab THEN 'key' WHEN a.tab = b.tab THEN 'type_conflict' ELSE 'moved' END"


@query(f"WITH {_SIDES_SQL} SELECT a.id AS left_id, b.id AS right_id, {_STEP} AS step FROM a JOIN b ON a.id = b.id WHERE {_MATCHED}")
def aligned_objects(spark, d) -> DataFrame:
    """Matches by tag, key, table and name, and name in kind; those by signature are left to ``possible_renames``."""
    return align.align(*_sides(spark, d)).where("step <> 'possible_rename'")


@query(f"""WITH {_SIDES_SQL}, hit AS (SELECT a.id FROM a JOIN b ON a.id = b.id WHERE {_MATCHED}), x AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM hit)), y AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM hit)),
  l AS (SELECT kind, sig, min(id) AS left_id FROM x GROUP BY 1, 2 HAVING count(*) = 1), r AS (SELECT kind, sig, min(id) AS right_id FROM y GROUP BY 1, 2 HAVING count(*) = 1)
  SELECT left_id, right_id FROM l JOIN r USING (kind, sig)""")
def possible_renames(spark, d) -> DataFrame:
    return align.align(*_sides(spark, d)).where("step = 'possible_rename'").select("left_id", "right_id")


@query(f"""WITH {_SIDES_SQL}, m AS (SELECT b.* FROM a JOIN b ON a.id = b.id WHERE {_MATCHED})
  SELECT a.id, CASE WHEN m.id IS NULL THEN 'missing' WHEN a.kind <> m.kind THEN 'type_conflict' WHEN a.name <> m.name THEN 'renamed' WHEN a.tab <> m.tab THEN 'moved' WHEN a.sig <> m.sig THEN 'different' ELSE 'same' END AS state FROM a LEFT JOIN m ON a.id = m.id""")
def cell_states(spark, d) -> DataFrame:
    """States of the cells that the alignment finds, signatures aside."""
    left, right = _sides(spark, d)
    return align.cell_states(left, right, align.align(left, right).where("step <> 'possible_rename'"))


@query(f"""WITH {_SIDES_SQL}, f AS (SELECT id FROM a WHERE id % 24 = 0), man AS (SELECT x.id AS l, y.id AS r FROM a x JOIN b y ON y.id = x.id + 2 WHERE x.id % 30 = 0 AND x.id % 24 <> 0 AND (x.id + 2) % 24 <> 0)
  SELECT l AS left_id, r AS right_id, 'manual' AS step FROM man
  UNION ALL SELECT a.id, b.id, {_STEP} FROM a JOIN b ON a.id = b.id WHERE ({_MATCHED}) AND a.id NOT IN (SELECT id FROM f) AND a.id NOT IN (SELECT l FROM man) AND b.id NOT IN (SELECT r FROM man)""")
def aligned_by_hand(spark, d) -> DataFrame:
    """Some pairs were confirmed against their tags, some are forbidden."""
    left, right = _sides(spark, d)
    k = F.col("id")
    manual = left.where((k % 30 == 0) & (k % 24 != 0) & ((k + 2) % 24 != 0)).select(k.alias("left_id"), (k + 2).alias("right_id"))
    never = left.where(k % 24 == 0).select(k.alias("left_id"), k.alias("right_id"))
    got = align.align(left, right, manual, never)
    return got.where("step <> 'possible_rename'")


@query("""SELECT 'tag' || p_size AS tag, count(*) AS objects, min(p_partkey) AS first FROM part WHERE p_partkey % 3 = 0 GROUP BY p_size HAVING count(*) > 1""")
def repeated_tags(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return align.duplicate_tags(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("tag"), F.col("p_size").cast("string"))).alias("tag")))


@query("""WITH k AS (SELECT p_partkey, p_size, p_brand FROM part)
  SELECT p_partkey, 'shape/size' AS path, 'changed' AS change, p_size::VARCHAR AS old_value, (p_size + 1)::VARCHAR AS new_value FROM k WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 1
  UNION ALL SELECT p_partkey, 'shape/size', 'changed', p_size::VARCHAR, '"' || p_size || '"' FROM k WHERE p_partkey % 3 = 1 AND p_partkey % 4 <> 1
  UNION ALL SELECT p_partkey, 'note', 'added', NULL, '"x"' FROM k WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, 'shape/brand', 'removed', '"' || p_brand || '"', NULL FROM k WHERE p_partkey % 7 = 0 AND p_partkey % 4 <> 1
  UNION ALL SELECT p_partkey, 'shape', 'changed', '{"brand":"' || p_brand || '","size":' || p_size || '}', '"{\\"size\\":1}"' FROM k WHERE p_partkey % 4 = 1
  UNION ALL SELECT p_partkey, 'deep/a~1b/c/' || n, 'changed', '[1,' || p_partkey || ']', '[' || p_partkey || ',1]' FROM k, (VALUES ('d'), ('e')) v(n) WHERE p_partkey % 11 = 0""")
def deep_property_diff(spark, d) -> DataFrame:
    """Sizes grown or turned into texts, an object turned into the text of one, and arrays four levels down in another order."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    line = lambda size, brand, note, shape, x, y: F.concat(F.lit('{"shape":'), shape(F.concat(F.lit('{"size":'), size, brand, F.lit("}"))), note, F.lit(',"deep":{"a/b":{"c":{"d":['), x, F.lit(","), y, F.lit('],"e":['), x, F.lit(","), y, F.lit("]}}}}"))
    size, one, key = F.col("p_size").cast("string"), F.lit("1"), k.cast("string")
    brand = F.concat(F.lit(',"brand":"'), "p_brand", F.lit('"'))
    old = p.select("p_partkey", line(size, brand, F.lit(""), lambda s: s, one, key).alias("json"))
    grown = F.when(k % 3 == 0, (F.col("p_size") + 1).cast("string")).when(k % 3 == 1, F.concat(F.lit('"'), size, F.lit('"'))).otherwise(size)
    text = lambda s: F.when(k % 4 == 1, r'"{\"size\":1}"').otherwise(s)
    turned = k % 11 == 0
    new = p.select("p_partkey", line(grown, F.when(k % 7 != 0, brand).otherwise(""), F.when(k % 5 == 0, ',"note":"x"').otherwise(""), text, F.when(turned, key).otherwise(one), F.when(turned, one).otherwise(key)).alias("json"))
    return align.deep_diff(old, new, "p_partkey", "json")


@query("""WITH a AS (SELECT o_custkey AS k, count(*)::DOUBLE AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*)::DOUBLE AS v FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1),
  j AS (SELECT a.v AS x, b.v AS y FROM a FULL JOIN b ON a.k = b.k), n AS (SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS c, count(*) FILTER (y - x NOT BETWEEN -1 AND 1) AS f, count(*) FILTER (y IS NULL) AS m, count(*) FILTER (x IS NULL) AS w FROM j)
  SELECT 'EXPECTED_DELTA' AS mode, f = 0 AS passed, c AS compared, f AS failed, m AS missing_rows, w AS new_rows FROM n
  UNION ALL SELECT 'SET_EQUIVALENCE', count(*) FILTER (s <> 0) = 0, 0, 0, coalesce(sum(greatest(s, 0)), 0)::BIGINT, coalesce(sum(-least(s, 0)), 0)::BIGINT
    FROM (SELECT sum(s) AS s FROM (SELECT k, v, 1 AS s FROM a UNION ALL SELECT k, v, -1 FROM b) GROUP BY k, v)
  UNION ALL SELECT 'SCHEMA_ONLY', x = y, 0, 0, greatest(x - y, 0), greatest(y - x, 0) FROM (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y)
  UNION ALL SELECT 'MONITOR', NULL, 0, 0, 0, 0""")
def regression_verdicts(spark, d) -> DataFrame:
    count = lambda where: table(spark, d, "orders").where(where).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("v"))
    a, b = count("o_orderkey % 3 <> 0"), count("o_orderkey % 4 <> 0")
    one = lambda mode, **kw: align.verdict(a, b, mode, ["k"], ["v"], **kw)
    return one("EXPECTED_DELTA", missing=True, new=True, least=-1.0, most=1.0).union(one("SET_EQUIVALENCE")).union(one("SCHEMA_ONLY")).union(one("MONITOR"))


@query(f"""WITH {GRAPH_SQL}, w AS (SELECT unnest(['nation:3', 'Customer#000000001', 'customer 000000002', 'customer', 'no such']) AS wanted),
  l AS (SELECT wanted, trim(regexp_replace(lower(wanted), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS k FROM w), n AS (SELECT id, trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS k FROM nodes)
  SELECT wanted, CASE WHEN wanted IN (SELECT id FROM nodes) THEN 1 ELSE (SELECT count(*) FROM n WHERE n.k = l.k) END::BIGINT AS candidates,
    CASE WHEN wanted IN (SELECT id FROM nodes) THEN wanted WHEN (SELECT count(*) FROM n WHERE n.k = l.k) = 1 THEN (SELECT min(id) FROM n WHERE n.k = l.k) END AS id FROM l""")
def resolved_names(spark, d) -> DataFrame:
    wanted = ["nation:3", "Customer#000000001", "customer 000000002", "customer", "no such"]
    return search.resolve(nodes(spark, d), spark.createDataFrame([(w,) for w in wanted], "wanted string"))


@query(f"""WITH {GRAPH_SQL}, e AS (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges), n AS (SELECT id, count(*) AS n FROM e GROUP BY id)
  SELECT type, count(*) AS cards, (count(*) + sum(coalesce(n, 0)))::BIGINT AS lines FROM nodes LEFT JOIN n USING (id) GROUP BY type""")
def cards(spark, d) -> DataFrame:
    lines = card_lines(nodes(spark, d), edges(spark, d)).groupBy("id").agg(F.count("*").alias("lines"))
    return nodes(spark, d).select("id", "type").join(lines, "id").groupBy("type").agg(F.count("*").alias("cards"), F.sum("lines").alias("lines"))


@query("""SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streamed_windows(spark, d) -> DataFrame:
    """Events an hour and type, read as a stream."""
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    counts = changes.windowed(changes.read_table(spark, d, "events"), "ts", ["event_type"], "1 hour")
    changes.drain(counts.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n"), f"{folder}/out", f"{folder}/checkpoint", "complete")
    return spark.read.parquet(f"{folder}/out")


@query("""WITH r AS (SELECT user_id, event_id, event_type AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
  SELECT user_id, event_id, CASE WHEN k = 1 THEN 'NEW' WHEN v = b THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM r""")
def streamed_changes(spark, d) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    changes.drain(changes.classify(changes.read_table(spark, d, "events"), "user_id", "event_id", ["event_type"]), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@query("""WITH o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 3 THEN 'r' || p_partkey ELSE 'm' || p_partkey END AS name,
    CASE WHEN p_partkey % 10 = 6 THEN '[m1] + [r' || (p_partkey + 7) || ']' ELSE '[M' || (p_partkey // 2) || '] * [r' || (p_partkey + 1) || ']' END AS formula FROM part WHERE p_partkey % 10 <> 9),
  r AS (SELECT DISTINCT k, lower(unnest(regexp_extract_all(formula, '\\[([^\\[\\]]+)\\]', 1))) AS name FROM o)
  SELECT 'o' || r.k AS from_id, r.name, min('o' || o.k) AS to_id FROM r JOIN o ON lower(o.name) = r.name GROUP BY 1, 2""")
def rescanned_edges(spark, d) -> DataFrame:
    """Formulas that name others, scanned once and then again after renames, deletions and new formulas; edges as the second scan leaves them."""
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    first, renamed = text("[M", F.floor(k / 2), "] * [r", k + 1, "]"), text("r", k)
    parts, state = table(spark, d, "part"), rescans.State(spark, f"{shared_folder(spark)}/rescan-{uuid4().hex}")
    records = lambda df, name, formula, gone: df.select(text("o", k).alias("id"), name.alias("name"), formula.alias("formula"), gone.alias("deleted"))
    rescans.rescan(state, records(parts, text("m", k), first, F.lit(False)), 0)
    changed = parts.where((k % 10).isin(3, 6, 9, 4))
    rescans.rescan(state, records(changed, F.when(k % 10 == 3, renamed).otherwise(text("m", k)), F.when(k % 10 == 6, text("[m1] + [r", k + 7, "]")).otherwise(first), k % 10 == 9), 1)
    return state.now("edges")
