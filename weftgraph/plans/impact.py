"""Impact, slices, sources, removal and safety queries; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import impact, traversal
from weftgraph.operators.compare import classify
from weftgraph.operators.impact import Rule
from weftgraph.plans.queries import query
from weftgraph.sources.star import GRAPH_SQL, edges, nodes, table

CONSUMERS = ("DEPENDS_ON", "REFERENCES", "USES")
RULES = [Rule("consumer_closure", CONSUMERS), Rule("contained_scope", ("CONTAINS",), out=True)]

_STEPS_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
  steps AS (SELECT to_id AS at, from_id AS id, 'consumer_closure' AS rule, type <> 'REFERENCES' AS fact FROM edges WHERE type IN {CONSUMERS}
    UNION ALL SELECT from_id, to_id, 'contained_scope', true FROM edges WHERE type = 'CONTAINS'),
  w AS (SELECT 'nation:3' AS id, 0 AS depth UNION SELECT s.id, depth + 1 FROM w JOIN steps s ON s.at = w.id),
  f AS (SELECT id, min(depth) AS depth FROM w GROUP BY id),
  steps_in AS (SELECT f.id, f.depth, s.at, s.rule, s.fact, row_number() OVER (PARTITION BY f.id ORDER BY s.at, s.rule, s.fact) AS k
    FROM f JOIN steps s ON s.id = f.id JOIN f g ON g.id = s.at AND g.depth = f.depth - 1),
  paths AS (SELECT 'nation:3' AS id, 0 AS depth, 'seed' AS rule, true AS fact, 'nation:3' AS path
    UNION ALL SELECT k.id, k.depth, k.rule, p.fact AND k.fact, p.path || '>' || k.id FROM paths p JOIN steps_in k ON k.at = p.id AND k.k = 1)
"""


def _closure(spark, d) -> DataFrame:
    links = impact.steps(edges(spark, d), RULES, F.col("type") != "REFERENCES")
    return impact.closure(links, spark.createDataFrame([("nation:3",)], "id string"))


@query(_STEPS_SQL + """SELECT id, depth::INTEGER AS depth, rule, CASE rule WHEN 'seed' THEN 'DIRECT' ELSE 'STRUCTURAL' END AS category, CASE WHEN fact THEN 'FACT' ELSE 'INFERRED' END AS certainty, path FROM paths""")
def impact_paths(spark, d) -> DataFrame:
    return _closure(spark, d).withColumn("path", F.array_join("path", ">"))


@query(_STEPS_SQL + """SELECT CASE WHEN fact AND depth <= 1 THEN 'breaks' WHEN fact THEN 'changes_value' ELSE 'needs_review' END AS severity, type, count(*) AS n FROM paths JOIN nodes USING (id) GROUP BY 1, 2""")
def impact_severity(spark, d) -> DataFrame:
    """Certain records block, the others want a review."""
    severity = F.when((F.col("certainty") == "FACT") & (F.col("depth") <= 1), "breaks").when(F.col("certainty") == "FACT", "changes_value").otherwise("needs_review")
    return _closure(spark, d).join(nodes(spark, d), "id").groupBy(severity.alias("severity"), "type").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation),
  before AS (SELECT 3 AS n UNION SELECT CASE WHEN e.a = x.n THEN e.b ELSE e.a END FROM before x JOIN e ON x.n IN (e.a, e.b)),
  after AS (SELECT 3 AS n UNION SELECT CASE WHEN e.a = x.n THEN e.b ELSE e.a END FROM after x JOIN e ON x.n IN (e.a, e.b) WHERE e.a <> 3)
  SELECT 'nation:' || n_nationkey AS id, n_nationkey IN (SELECT n FROM before) AS before, n_nationkey IN (SELECT n FROM after) AS after FROM nation""")
def relationship_reach(spark, d) -> DataFrame:
    """What a filter on one object reaches both ways, before and after a relationship goes."""
    name = lambda c: F.concat(F.lit("nation:"), c.cast("string"))
    own = table(spark, d, "nation").select("n_nationkey", name(F.col("n_nationkey")).alias("from_id"), name((F.col("n_nationkey") * 7 + 3) % 25).alias("to_id"), F.lit("RELATES").alias("type"))
    seed = spark.createDataFrame([("nation:3",)], "id string")
    reach = lambda e, out: traversal.walk(traversal.either_way(e), seed, None).select("id", F.lit(True).alias(out))
    both = own.select(F.col("from_id").alias("id")).join(reach(own, "before"), "id", "left").join(reach(own.where("n_nationkey <> 3"), "after"), "id", "left")
    return both.select("id", F.coalesce("before", F.lit(False)).alias("before"), F.coalesce("after", F.lit(False)).alias("after"))


@query(f"""WITH {GRAPH_SQL} SELECT u.from_id AS origin, r.to_id AS source, 2 AS depth, min(r.from_id) AS via FROM edges u JOIN edges r ON r.from_id = u.to_id
  WHERE u.type = 'USES' AND r.type = 'REFERENCES' GROUP BY 1, 2""")
def upstream_sources(spark, d) -> DataFrame:
    e, n = edges(spark, d).where("type in ('USES', 'REFERENCES')"), nodes(spark, d)
    return impact.upstream(e, n.where("type = 'ORDER'").select("id"), n.where("type = 'SUPPLIER'").select("id"))


MOVES = [
    ("target", ("CONTAINS",), False, "parent"), ("parent", ("CONTAINS",), False, "parent"), ("target", ("CONTAINS",), True, "child"),
    ("target", CONSUMERS, True, "dependency"), ("dependency", CONSUMERS, True, "dependency"), ("dependency", ("CONTAINS",), False, "parent"), ("target", CONSUMERS, False, "consumer"),
]


@query(f"""WITH RECURSIVE {GRAPH_SQL}, s AS (SELECT id, 'target' AS mode FROM nodes WHERE id = 'part:1'
  UNION SELECT CASE WHEN m.along THEN e.to_id ELSE e.from_id END, m.nxt FROM s JOIN (VALUES
    ('target', 'CONTAINS', false, 'parent'), ('parent', 'CONTAINS', false, 'parent'), ('target', 'CONTAINS', true, 'child'), ('target', '', true, 'dependency'),
    ('dependency', '', true, 'dependency'), ('dependency', 'CONTAINS', false, 'parent'), ('target', '', false, 'consumer')) m(mode, kind, along, nxt) ON m.mode = s.mode
    JOIN edges e ON (e.type = 'CONTAINS') = (m.kind = 'CONTAINS') AND s.id = CASE WHEN m.along THEN e.from_id ELSE e.to_id END)
  SELECT id, mode FROM s""")
def context_slice(spark, d) -> DataFrame:
    return impact.context_slice(edges(spark, d), nodes(spark, d).where("id = 'part:1'").select("id"), MOVES)


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS owner, l_partkey AS item FROM lineitem), c AS (SELECT owner, count(*) AS used, count(*) FILTER (p_size <= 10) AS lost FROM u LEFT JOIN part ON item = p_partkey GROUP BY owner)
  SELECT owner, used, lost, CASE WHEN used = lost THEN 'remove_owner' ELSE 'remove_field' END AS action FROM c WHERE lost > 0""")
def removal_preview(spark, d) -> DataFrame:
    uses = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("item"))
    return impact.removal_preview(uses, table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("item")))


@query("""WITH k AS (SELECT * FROM part WHERE p_size > 10), g AS (SELECT * FROM part WHERE p_size <= 10)
  SELECT g.p_partkey AS item, (SELECT count(*) FROM k WHERE k.p_type = g.p_type) AS candidates,
    coalesce((SELECT min(p_partkey) FROM k WHERE k.p_type = g.p_type AND k.p_brand = g.p_brand), (SELECT min(p_partkey) FROM k WHERE k.p_type = g.p_type)) AS best,
    (SELECT count(*) FROM k WHERE k.p_type = g.p_type) > 0 AND (SELECT count(*) FROM k WHERE k.p_type = g.p_type AND k.p_brand = g.p_brand) = 0 AS type_warning FROM g""")
def repoint_candidates(spark, d) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_type", "p_brand", "p_size")
    return impact.repoint(items, items.where("p_size <= 10").select("item"), "p_type", "p_brand")


@query(f"""WITH {GRAPH_SQL} SELECT DISTINCT to_id AS id, from_id AS "user" FROM edges WHERE type = 'USES' AND CAST(substr(to_id, 6) AS BIGINT) % 20 = 0 AND CAST(substr(from_id, 7) AS BIGINT) % 10 <> 0""")
def breaking_users(spark, d) -> DataFrame:
    key = lambda c: F.split(F.col(c), ":")[1].cast("long")
    n = nodes(spark, d)
    return impact.breaks(edges(spark, d).where("type = 'USES'"), n.where((F.col("type") == "PART") & (key("id") % 20 == 0)).select("id"), n.where((F.col("type") == "ORDER") & (key("id") % 10 != 0)).select("id"))


@query(r"""WITH x AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) AS name FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name FROM benchmark)
  SELECT name, count(*) AS users FROM x WHERE name NOT IN (SELECT name FROM k) GROUP BY name""")
def missing_names(spark, d) -> DataFrame:
    """Names that texts use and the catalogue lacks."""
    pattern = "[A-Z][a-z]{3,}"
    known = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("name"))
    return impact.needs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), F.col("text"), pattern, known)


@query(f"""WITH {GRAPH_SQL}, p AS (SELECT 'part:' || p_partkey AS id, p_partkey AS k, p_name, p_size FROM part),
  st AS (SELECT id, CASE WHEN k % 20 = 0 THEN 'DELETED' WHEN k % 7 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS status FROM p),
  b AS (SELECT to_id AS id, count(*) AS users FROM (SELECT DISTINCT to_id, from_id FROM edges WHERE type = 'USES') GROUP BY to_id)
  SELECT CASE WHEN status = 'DELETED' AND users > 0 THEN 'BREAKS' WHEN status = 'CHANGED' AND users > 0 THEN 'NEEDS_CHECK' ELSE status END AS verdict, count(*) AS n, coalesce(sum(users), 0)::BIGINT AS users FROM st LEFT JOIN b USING (id) GROUP BY 1""")
def safety_report(spark, d) -> DataFrame:
    """Per verdict, worst first, the objects of a change and those that use them."""
    old = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    new = old.where("p_partkey % 20 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    status = classify(old, new, "p_partkey", ["p_name", "p_size"]).select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), "status")
    users = edges(spark, d).where("type = 'USES'").groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("users"))
    verdict = F.when((F.col("status") == "DELETED") & (F.col("users") > 0), "BREAKS").when((F.col("status") == "CHANGED") & (F.col("users") > 0), "NEEDS_CHECK").otherwise(F.col("status"))
    return status.join(users, "id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.coalesce(F.sum("users"), F.lit(0)).alias("users"))
