"""Impact by all rules, unknowns, required tests, item filters and facets; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import analysis
from weftgraph.plans.queries import query
from weftgraph.sources.catalog import CATALOG_SQL, links, objects
from weftgraph.sources.star import table


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """The metadata graph with a relationship from each nation's first supplier column to that of the nation seven on, and behaviours."""
    o = objects(spark, d)
    first = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k"))
    key = lambda c: F.concat(F.lit("column:"), F.col(c).cast("string"))
    pairs = first.select(F.col("s_nationkey").alias("a"), key("k").alias("from_column_id")).join(first.select(((F.col("s_nationkey") + 18) % 25).alias("a"), key("k").alias("to_column_id")), "a")
    home = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.concat(F.lit("model:"), F.col("n_regionkey").cast("string")).alias("model_id"))
    none = F.lit(None).cast("string")
    rels = pairs.join(home, "a").select(F.concat(F.lit("rel:"), F.col("a").cast("string")).alias("id"), F.lit("RELATIONSHIP").alias("type"), F.lit("rel").alias("name"), "model_id", none.alias("report_id"), none.alias("parent_id"), "from_column_id", "to_column_id")
    base = o.select("id", "type", "name", "model_id", "report_id", "parent_id", none.alias("from_column_id"), none.alias("to_column_id"))
    act = F.when((F.col("type") == "MEASURE") & F.col("id").endswith("3"), F.array(F.lit("ALL"), F.lit("SUM"))).otherwise(F.array().cast("array<string>"))
    return base.unionByName(rels).withColumn("behaviors", act), links(spark, d).select("id", "type", "from_id", "to_id", "evidence_class")


_STEPS = """steps AS (
    SELECT from_id AS at, to_id AS id, 'contained_scope' AS rule, evidence_class = 'FACT' AS fact FROM links JOIN objects p ON p.id = from_id WHERE links.type = 'CONTAINS' AND p.type IN ('MODEL', 'TABLE')
    UNION ALL SELECT to_id, from_id, 'consumer_closure', evidence_class = 'FACT' FROM links WHERE type IN ('DEPENDS_ON', 'REFERENCES', 'USES')
    UNION ALL SELECT to_id, from_id, 'report_ancestry', true FROM links JOIN objects c ON c.id = to_id WHERE links.type = 'CONTAINS' AND c.type IN ('VISUAL', 'PAGE'))"""
_CLOSURE = """w AS (SELECT id, depth, fact FROM seeds UNION SELECT s.id, w.depth + 1, w.fact AND s.fact FROM w JOIN steps s ON s.at = w.id WHERE w.depth < 40),
  shortest AS (SELECT id, min(depth) AS depth FROM w GROUP BY id), seen AS (SELECT id, depth, bool_or(fact) AS fact FROM w JOIN shortest USING (id, depth) GROUP BY 1, 2)"""


_COLUMN_SQL = f"""{CATALOG_SQL}, {_STEPS},
  calc AS (SELECT c.id FROM objects c JOIN objects t ON t.id = 'column:3' AND c.model_id = t.model_id WHERE c.type IN ('MEASURE', 'COLUMN', 'TABLE')),
  seeds AS (SELECT id, 1 AS depth, false AS fact FROM calc WHERE id <> 'column:3' UNION ALL SELECT 'column:3', 0, true), {_CLOSURE},
  told AS (SELECT 'column:3' AS object_id, 'seed' AS rule, 'DIRECT' AS category, 0 AS depth, true AS fact
    UNION ALL SELECT id, 'model_context', 'POTENTIAL_BEHAVIORAL', 1, false FROM calc
    UNION ALL SELECT s.id, s.rule, 'STRUCTURAL', v.depth + 1, v.fact AND s.fact FROM seen v JOIN steps s ON s.at = v.id),
  best AS (SELECT object_id, rule, category, min(depth) AS depth FROM told GROUP BY 1, 2, 3),
  records AS (SELECT object_id, rule, category, CASE WHEN category = 'POTENTIAL_BEHAVIORAL' OR NOT bool_or(fact) THEN 'INFERRED' ELSE 'FACT' END AS evidence_class, depth::INTEGER AS depth FROM told JOIN best USING (object_id, rule, category, depth) GROUP BY 1, 2, 3, depth)"""


@query(f"WITH RECURSIVE {_COLUMN_SQL} SELECT 'column:3' AS root, * FROM records")
def column_impact(spark, d) -> DataFrame:
    """A changed column: itself, the calculations of its model, and all that consumes or contains what is affected."""
    return analysis.impact(*_graph(spark, d), ["column:3"])


_RELATION_SQL = f"""{CATALOG_SQL}, {_STEPS},
  first AS (SELECT s_nationkey AS n, min(s_suppkey) AS k FROM supplier GROUP BY 1),
  rels AS (SELECT a.n AS n, a.k AS f, b.k AS t FROM first a JOIN first b ON (b.n + 18) % 25 = a.n),
  target AS (SELECT min(n) AS n FROM rels),
  joined AS (SELECT s.s_nationkey AS a, t.s_nationkey AS b FROM rels JOIN supplier s ON s.s_suppkey = f JOIN supplier t ON t.s_suppkey = rels.t),
  both_ways AS (SELECT a, b FROM joined UNION SELECT b, a FROM joined),
  reach AS (SELECT a AS n FROM joined WHERE a = (SELECT n FROM target) UNION SELECT b FROM joined WHERE a = (SELECT n FROM target) UNION SELECT e.b FROM reach r JOIN both_ways e ON e.a = r.n),
  model AS (SELECT 'model:' || n_regionkey AS id FROM nation WHERE n_nationkey = (SELECT n FROM target)),
  tables AS (SELECT 'table:' || n AS id FROM reach),
  calc AS (SELECT o.id FROM objects o WHERE o.model_id = (SELECT id FROM model) AND o.type IN ('MEASURE', 'COLUMN', 'TABLE') AND (o.parent_id IN (SELECT id FROM tables) OR o.id IN (SELECT id FROM tables)
      OR o.id IN (SELECT l.from_id FROM links l JOIN objects t ON t.id = l.to_id WHERE l.type IN ('DEPENDS_ON', 'REFERENCES', 'USES') AND t.parent_id IN (SELECT id FROM tables))
      OR o.type = 'MEASURE' AND o.id NOT IN (SELECT from_id FROM links WHERE type IN ('DEPENDS_ON', 'REFERENCES', 'USES')))),
  ends AS (SELECT unnest(['column:' || f, 'column:' || t]) AS id FROM rels WHERE n = (SELECT n FROM target)),
  seeds AS (SELECT id, 1 AS depth, false AS fact FROM calc UNION ALL SELECT 'rel:' || n, 0, true FROM target), {_CLOSURE},
  told AS (SELECT 'rel:' || n AS object_id, 'seed' AS rule, 'DIRECT' AS category FROM target
    UNION ALL SELECT id, 'relationship_endpoint', 'STRUCTURAL' FROM ends UNION ALL SELECT id, 'filter_influence', 'POTENTIAL_BEHAVIORAL' FROM tables
    UNION ALL SELECT id, 'calculation_context', 'POTENTIAL_BEHAVIORAL' FROM calc UNION ALL SELECT id, 'dax_override:ALL', 'CONDITIONAL' FROM calc WHERE id LIKE 'measure:%3'
    UNION ALL SELECT s.id, s.rule, CASE WHEN s.rule = 'consumer_closure' THEN 'POTENTIAL_BEHAVIORAL' ELSE 'STRUCTURAL' END FROM seen v JOIN steps s ON s.at = v.id)"""


@query(f"WITH RECURSIVE {_RELATION_SQL} SELECT rule, category, count(DISTINCT object_id) AS objects, min(object_id) AS first, max(object_id) AS last FROM told GROUP BY 1, 2")
def relationship_impact(spark, d) -> DataFrame:
    """A changed relationship: its ends, the tables a filter reaches over any relationship, calculations there and their overrides."""
    o, e = _graph(spark, d)
    target = o.where("type = 'RELATIONSHIP'").agg(F.min(F.substring("id", 5, 10).cast("int"))).first()[0]
    got = analysis.impact(o, e, [f"rel:{target}"])
    return got.groupBy("rule", "category").agg(F.countDistinct("object_id").alias("objects"), F.min("object_id").alias("first"), F.max("object_id").alias("last"))


_ITEMS_SQL = f"""{_COLUMN_SQL}, i AS (SELECT r.*, category IN ('DIRECT', 'STRUCTURAL') AND evidence_class = 'FACT' AS sure, o.type AS object_type, o.name, coalesce(o.report_id, o.model_id) AS source_id FROM records r JOIN objects o ON o.id = r.object_id),
  items AS (SELECT *, CASE WHEN sure THEN 'breaks' ELSE 'needs_review' END AS severity, CASE WHEN sure THEN 'certain' ELSE 'possible' END AS certainty, sure AS blocking FROM i)"""


@query(f"""WITH RECURSIVE {_ITEMS_SQL}, f AS (SELECT * FROM items WHERE contains(lower(name), 'building') OR contains(rule, 'building') OR contains(lower(name), 'customer') OR contains(rule, 'customer')),
  g AS (SELECT unnest([{{'facet': 'direction', 'value': 'breaks'}}, {{'facet': 'blocking', 'value': blocking::VARCHAR}}, {{'facet': 'severity', 'value': severity}}, {{'facet': 'certainty', 'value': certainty}}, {{'facet': 'object_type', 'value': object_type}}]) AS x FROM items WHERE contains(lower(name), 'customer') OR contains(rule, 'customer')),
  c AS (SELECT x.facet AS facet, x.value AS value, count(*) AS n FROM g GROUP BY 1, 2), z AS (SELECT unnest(['direction', 'direction', 'blocking', 'blocking', 'certainty', 'certainty']) AS facet, unnest(['breaks', 'needs', 'true', 'false', 'certain', 'possible']) AS value)
  SELECT facet, value, coalesce(n, 0) AS n FROM z FULL JOIN c USING (facet, value)""")
def impact_facets(spark, d) -> DataFrame:
    """Facets over the impact items on customers' visuals, counted after the filter."""
    o, e = _graph(spark, d)
    rows = analysis.items(analysis.impact(o, e, ["column:3"]), o, F.lit(True))
    return analysis.facets(analysis.filter_items(rows, text="Customer"))


@query(f"""WITH RECURSIVE {_ITEMS_SQL} SELECT rule, object_type, count(*) AS n FROM items WHERE severity = 'needs_review' AND certainty = 'possible' AND NOT blocking AND object_type IN ('MEASURE') GROUP BY 1, 2""")
def impact_filtered(spark, d) -> DataFrame:
    o, e = _graph(spark, d)
    rows = analysis.items(analysis.impact(o, e, ["column:3"]), o, F.lit(True))
    return analysis.filter_items(rows, severity="needs_review", certainty="possible", blocking=False, object_type="MEASURE", direction="breaks").groupBy("rule", "object_type").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_COLUMN_SQL}, n AS (SELECT count(DISTINCT object_id) AS targets FROM records JOIN objects o ON o.id = object_id WHERE o.type IN ('MEASURE', 'VISUAL'))
  SELECT unnest({analysis.TESTS}) AS category, targets FROM n WHERE targets > 0""")
def required_tests(spark, d) -> DataFrame:
    o, e = _graph(spark, d)
    return analysis.required_tests(analysis.impact(o, e, ["column:3"]), o)


@query(f"""WITH {CATALOG_SQL}, o AS (SELECT * REPLACE (CASE WHEN id = 'report:BUILDING-1' THEN NULL ELSE model_id END AS model_id) FROM objects WHERE id NOT LIKE 'measure:%77'), e AS (SELECT * FROM links WHERE NOT (type = 'USES' AND from_id LIKE '%5'))
  SELECT 'DANGLING_GRAPH_ENDPOINT' AS reason, x AS object_id FROM (SELECT from_id AS x FROM e UNION SELECT to_id FROM e) WHERE x NOT IN (SELECT id FROM o)
  UNION ALL SELECT 'UNRESOLVED_REPORT_MODEL', id FROM o WHERE type = 'REPORT' AND model_id IS NULL
  UNION ALL SELECT 'UNRESOLVED_VISUAL_BINDING', id FROM o WHERE type = 'VISUAL' AND model_id = 'model:2' AND id NOT IN (SELECT from_id FROM e WHERE type = 'USES')""")
def impact_unknowns(spark, d) -> DataFrame:
    o, e = _graph(spark, d)
    left = o.where("id NOT LIKE 'measure:%77'").withColumn("model_id", F.when(F.col("id") != "report:BUILDING-1", F.col("model_id")))
    return analysis.unknowns(left, e.where("NOT (type = 'USES' AND from_id LIKE '%5')"), ["model:2"])


@query(f"""WITH {CATALOG_SQL}, o AS (SELECT * FROM objects WHERE id <> 'table:3' AND NOT (type = 'COLUMN' AND id LIKE '%9')),
  c AS (SELECT id, parent_id IN (SELECT id FROM o) AS held FROM o WHERE type = 'COLUMN'),
  r AS (SELECT 'relation:' || s_suppkey AS id, 'column:' || s_suppkey AS f, 'column:' || (s_suppkey + 1) AS t FROM supplier),
  u AS (
    SELECT CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'UNRESOLVED_RELATIONSHIP' ELSE 'MISSING_ENDPOINT_TABLE' END AS reason, r.id FROM r LEFT JOIN c a ON a.id = f LEFT JOIN c b ON b.id = t WHERE a.id IS NULL OR b.id IS NULL OR NOT (a.held AND b.held)
    UNION ALL SELECT 'DAX_DIAGNOSTICS', 'measure:' || p_partkey FROM part WHERE p_partkey % 6 = 0 AND 'measure:' || p_partkey IN (SELECT id FROM o WHERE model_id = 'model:2')
    UNION ALL SELECT 'UNRESOLVED_FIELDS', id FROM o WHERE type = 'REPORT' UNION ALL SELECT 'UNREAD_M_QUERY', 'query:' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)
  SELECT 'INCOMPLETE' AS status, reason, count(*) AS objects FROM u GROUP BY reason""")
def impact_completeness(spark, d) -> DataFrame:
    """Why an impact on a model and a data source is not complete, and over how many objects."""
    o = objects(spark, d)
    left = o.where("id <> 'table:3' AND NOT (type = 'COLUMN' AND id LIKE '%9')")
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    name = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    supplier = table(spark, d, "supplier")
    source = left.limit(1).select(*[F.lit("source:1" if c == "id" else "DATA_SOURCE" if c == "type" else None).cast("string").alias(c) for c in left.columns])
    relations = supplier.select(name("relation:", s).alias("id"), name("column:", s).alias("from_column_id"), name("column:", s + 1).alias("to_column_id"))
    findings = table(spark, d, "part").where(k % 6 == 0).select(name("measure:", k).alias("object_id"), F.lit("dax_diagnostics").alias("finding")).union(left.where("type IN ('REPORT', 'PAGE')").select("id", F.when(F.col("type") == "REPORT", "unresolved_fields").otherwise("notes")))
    queries = supplier.where(s % 10 == 0).select(name("query:", s).alias("id"))
    return analysis.completeness(analysis.unread(left.union(source), ["model:2"], spark.createDataFrame([("source:1",)], "id string"), relations, findings, queries))
