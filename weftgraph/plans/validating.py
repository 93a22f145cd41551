"""Validation queries over the metadata graph; registers with ``queries``.

The graph is damaged in known places first: objects of some keys are dropped, renamed or moved, and
links get odd evidence. Every query works over all objects and links that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut
from weftgraph.operators import components, traversal, validation
from weftgraph.plans.queries import query
from weftgraph.sources.catalog import CATALOG_SQL, links, objects
from weftgraph.sources.star import table


def _damaged(spark, d) -> tuple[DataFrame, DataFrame]:
    o, e = objects(spark, d), links(spark, d)
    left = o.where("NOT (type = 'COLUMN' AND id LIKE '%7') AND id <> 'page:BUILDING-3'").withColumn("status", F.when(F.col("id").like("measure:%5"), "lost").otherwise(F.col("status")))
    left = left.withColumn("model_id", F.when(F.col("id") == "table:4", "model:9").when(F.col("id") == "table:5", "table:6").otherwise(F.col("model_id")))
    odd = e.withColumn("source", F.when(F.col("to_id").like("measure:%9"), "").otherwise(F.col("source")))
    return left, odd.withColumn("evidence_class", F.when(F.col("to_id") == "table:2", "OBSERVED").otherwise(F.col("evidence_class")))


_DAMAGED_SQL = f"""{CATALOG_SQL},
  o AS (SELECT * REPLACE (CASE WHEN id LIKE 'measure:%5' THEN 'lost' ELSE status END AS status,
      CASE WHEN id = 'table:4' THEN 'model:9' WHEN id = 'table:5' THEN 'table:6' ELSE model_id END AS model_id)
    FROM objects WHERE NOT (type = 'COLUMN' AND id LIKE '%7') AND id <> 'page:BUILDING-3'),
  e AS (SELECT * REPLACE (CASE WHEN to_id LIKE 'measure:%9' THEN '' ELSE source END AS source, CASE WHEN to_id = 'table:2' THEN 'OBSERVED' ELSE evidence_class END AS evidence_class) FROM links)"""


@query(f"""WITH {_DAMAGED_SQL},
  held AS (SELECT DISTINCT e.to_id AS id, p.type AS parent FROM e JOIN o p ON p.id = e.from_id WHERE e.type = 'CONTAINS'),
  wanted AS (SELECT id, type FROM o WHERE type IN ('TABLE', 'COLUMN', 'MEASURE', 'PAGE', 'VISUAL')),
  fine AS (SELECT w.id FROM wanted w JOIN held h USING (id) WHERE (w.type, h.parent) IN (('TABLE', 'MODEL'), ('COLUMN', 'TABLE'), ('MEASURE', 'TABLE'), ('MEASURE', 'MODEL'), ('PAGE', 'REPORT'), ('VISUAL', 'PAGE')))
  SELECT 'invalid_node_status' AS code, 'ERROR' AS severity, id AS object_id, NULL::VARCHAR AS edge_id, NULL::VARCHAR AS detail FROM o WHERE status NOT IN ('factual', 'candidate', 'approved', 'rejected', 'overridden')
  UNION ALL SELECT 'missing_edge_provenance', 'ERROR', NULL, id, NULL FROM e WHERE trim(source) = ''
  UNION ALL SELECT 'observed_type_mismatch', 'ERROR', NULL, id, NULL FROM e WHERE evidence_class = 'OBSERVED' AND type <> 'OBSERVED_WITH'
  UNION ALL SELECT 'fact_status_mismatch', 'ERROR', NULL, id, NULL FROM e WHERE evidence_class = 'FACT' AND status <> 'factual'
  UNION ALL SELECT 'dangling_edge_endpoint', 'ERROR', NULL, id, x FROM (SELECT id, unnest([from_id, to_id]) AS x FROM e) WHERE x NOT IN (SELECT id FROM o)
  UNION ALL SELECT 'orphan_object', 'WARNING', id, NULL, type FROM wanted WHERE id NOT IN (SELECT id FROM fine)""")
def graph_integrity(spark, d) -> DataFrame:
    return validation.integrity(*_damaged(spark, d))


@query(f"""WITH {_DAMAGED_SQL}, m AS (SELECT o.id, o.model_id, t.type AS kind FROM o LEFT JOIN o t ON t.id = o.model_id WHERE o.type IN ('TABLE', 'COLUMN', 'MEASURE')),
  r AS (SELECT o.id, o.report_id, t.type AS kind FROM o LEFT JOIN o t ON t.id = o.report_id WHERE o.type IN ('PAGE', 'VISUAL')),
  ends AS (SELECT e.id, e.type, a.type AS s, b.type AS t FROM e JOIN o a ON a.id = e.from_id JOIN o b ON b.id = e.to_id)
  SELECT 'missing_model_reference' AS code, 'ERROR' AS severity, id AS object_id, NULL::VARCHAR AS edge_id, model_id AS detail FROM m WHERE kind IS NULL
  UNION ALL SELECT 'invalid_model_reference', 'ERROR', id, NULL, model_id FROM m WHERE kind <> 'MODEL'
  UNION ALL SELECT 'missing_report_reference', 'ERROR', id, NULL, report_id FROM r WHERE kind IS NULL
  UNION ALL SELECT 'missing_parent_reference', 'ERROR', id, NULL, parent_id FROM o WHERE type IN ('PAGE', 'VISUAL') AND parent_id NOT IN (SELECT id FROM o)
  UNION ALL SELECT 'invalid_visual_binding', 'ERROR', NULL, id, NULL FROM ends WHERE type = 'USES' AND s = 'VISUAL' AND t NOT IN ('TABLE', 'COLUMN', 'MEASURE')""")
def reference_integrity(spark, d) -> DataFrame:
    return validation.reference_rules(*_damaged(spark, d))


def _looped(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every fortieth measure also depends on one that depends on it, and some depend on what is gone."""
    o, e = objects(spark, d), links(spark, d)
    k = F.col("p_partkey")
    more = table(spark, d, "part").where((k % 40 == 1) & (k > 1)).select(F.concat(F.lit("measure:"), F.floor(k / 2).cast("string")).alias("from_id"), F.concat(F.lit("measure:"), k.cast("string")).alias("to_id"))
    base = e.select("id", "type", "from_id", "to_id")
    back = more.select(F.concat_ws("|", F.lit("back"), "from_id", "to_id").alias("id"), F.lit("DEPENDS_ON").alias("type"), "from_id", "to_id")
    odd = o.where("type = 'PAGE'").select(F.concat(F.lit("odd|"), "id").alias("id"), F.lit("DEPENDS_ON").alias("type"), F.col("id").alias("from_id"), F.lit("measure:1").alias("to_id"))
    return o.where("id NOT LIKE 'measure:%99'"), base.union(back).union(odd)


@query(f"""WITH RECURSIVE {CATALOG_SQL}, o AS (SELECT * FROM objects WHERE id NOT LIKE 'measure:%99'),
  e AS (SELECT id, from_id, to_id FROM links WHERE type = 'DEPENDS_ON'
    UNION ALL SELECT 'back|measure:' || (p_partkey // 2) || '|measure:' || p_partkey, 'measure:' || (p_partkey // 2), 'measure:' || p_partkey FROM part WHERE p_partkey % 40 = 1 AND p_partkey > 1
    UNION ALL SELECT 'odd|' || id, id, 'measure:1' FROM objects WHERE type = 'PAGE'),
  reach AS (SELECT from_id AS a, to_id AS b FROM e UNION SELECT r.a, e.to_id FROM reach r JOIN e ON e.from_id = r.b),
  loops AS (SELECT x.a AS id, min(x.b) AS cycle FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
  told AS (SELECT e.*, s.type AS s, t.type AS t FROM e LEFT JOIN o s ON s.id = from_id LEFT JOIN o t ON t.id = to_id)
  SELECT 'broken_dax_dependency' AS code, 'ERROR' AS severity, NULL::VARCHAR AS object_id, id AS edge_id, NULL::VARCHAR AS detail FROM told WHERE s IS NULL OR t IS NULL
  UNION ALL SELECT 'invalid_dax_dependency_source', 'ERROR', NULL, id, NULL FROM told WHERE s IS NOT NULL AND t IS NOT NULL AND s NOT IN ('MEASURE', 'COLUMN')
  UNION ALL SELECT 'dax_dependency_cycle', 'BLOCKING', id, NULL, cycle FROM loops""")
def dependency_integrity(spark, d) -> DataFrame:
    return validation.dependency_rules(*_looped(spark, d))


_RINGS = """k AS (SELECT p_partkey AS k, p_partkey // 7 AS ring, p_partkey % 7 AS spot FROM part),
  e AS (SELECT 'm' || lpad(k::VARCHAR, 9, '0') AS a, 'm' || lpad(t::VARCHAR, 9, '0') AS b FROM (
    SELECT k, 7 * ring + (spot + 1) % 7 AS t FROM k UNION ALL SELECT k, 7 * ring + (spot + 4) % 7 FROM k WHERE ring % 3 = 0 AND spot = 2
    UNION ALL SELECT k, k + 7 FROM k WHERE spot = 3 AND ring % 4 <> 0 UNION ALL SELECT k, k FROM k WHERE k % 50 = 0 UNION ALL SELECT k, k - 7 FROM k WHERE spot = 5 AND ring % 12 = 6))"""


def _rings(spark, d) -> DataFrame:
    """Rings of seven, some with a short cut, some joined to the next one way or both, and objects that depend on themselves."""
    k = F.col("p_partkey")
    ring, at = F.floor(k / 7), k % 7
    to = lambda ok, t: F.when(ok, t)
    ends = F.array_compact(F.array(7 * ring + (at + 1) % 7, to((ring % 3 == 0) & (at == 2), 7 * ring + (at + 4) % 7), to((at == 3) & (ring % 4 != 0), k + 7), to(k % 50 == 0, k), to((at == 5) & (ring % 12 == 6), k - 7)))
    name = lambda c: F.concat(F.lit("m"), F.lpad(c.cast("string"), 9, "0"))
    return table(spark, d, "part").select(name(k).alias("from_id"), F.explode(ends).alias("t")).select("from_id", name(F.col("t")).alias("to_id"))


@query(f"""WITH RECURSIVE {_RINGS},
  reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
  members AS (SELECT x.a AS id, min(x.b) AS cycle FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
  inner_e AS (SELECT DISTINCT m.cycle, e.a, e.b FROM e JOIN members m ON m.id = e.a JOIN members n ON n.id = e.b AND n.cycle = m.cycle),
  w AS (SELECT DISTINCT cycle, [cycle] AS path FROM members
    UNION ALL SELECT w.cycle, list_append(w.path, i.b) FROM w JOIN inner_e i ON i.cycle = w.cycle AND i.a = w.path[-1]
    WHERE (len(w.path) = 1 OR w.path[-1] <> w.cycle) AND (i.b = w.cycle OR NOT list_contains(w.path, i.b)) AND len(w.path) <= 7),
  best AS (SELECT * FROM w WHERE len(path) > 1 AND path[-1] = cycle QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY len(path), list_reverse(path)) = 1)
  SELECT cycle, (SELECT count(*) FROM members m WHERE m.cycle = best.cycle) AS members, array_to_string(path, '>') AS path FROM best""")
def dependency_cycles(spark, d) -> DataFrame:
    """Every group of objects that depend on each other, with a shortest cycle through its smallest one."""
    e = _rings(spark, d)
    groups = cut(components.strong_components(e))
    nodes = components.shortest_cycles(e, groups).groupBy("cycle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ">").alias("path"))
    return nodes.join(groups.groupBy("cycle").agg(F.count("*").alias("members")), "cycle")


@query(f"""WITH {CATALOG_SQL}, gone AS (SELECT id, source_id FROM objects WHERE (type = 'COLUMN' AND id LIKE '%7') OR id LIKE 'table:%3'),
  u AS (SELECT DISTINCT to_id, from_id FROM links WHERE to_id IN (SELECT id FROM gone)),
  r AS (SELECT to_id, from_id, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS n, count(*) OVER (PARTITION BY to_id) AS c FROM u)
  SELECT g.id AS object_id, g.source_id, coalesce(max(c), 0) AS dependents, coalesce(string_agg(from_id, ',' ORDER BY from_id) FILTER (n <= 5), '') AS examples FROM gone g LEFT JOIN r ON r.to_id = g.id GROUP BY 1, 2""")
def disappeared_sources(spark, d) -> DataFrame:
    o = objects(spark, d)
    after = o.where("NOT ((type = 'COLUMN' AND id LIKE '%7') OR id LIKE 'table:%3')")
    return validation.disappeared(o, links(spark, d), after).withColumn("examples", F.array_join("examples", ","))


@query(f"""WITH {CATALOG_SQL} SELECT v.id, p.parent_id AS ancestor FROM objects v JOIN objects p ON p.id = v.parent_id WHERE v.type = 'VISUAL'""")
def report_of_visual(spark, d) -> DataFrame:
    """Up the parents from each visual to its report."""
    o = objects(spark, d)
    return traversal.path_of_parents(o, o.where("type = 'VISUAL'").select("id"), ["REPORT"])
