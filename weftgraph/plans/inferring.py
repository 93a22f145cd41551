"""Formula links, meanings, conflicts, inspection and selection queries; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.expressions import literal_table, plain_text, variables
from weftgraph.operators import align, formulas, inference, inspection, validation
from weftgraph.plans.queries import query
from weftgraph.sources.catalog import CATALOG_SQL, links, objects
from weftgraph.sources.star import table

_K = "p_partkey"


def _measures(spark, d) -> DataFrame:
    """One formula a part: filters over columns and tables, relationships by two columns, or neither; two models."""
    k = F.col(_K)
    text = (
        F.when(k % 5 == 0, "CALCULATE([M], FILTER(ALL('Parts'), Parts[Size] > 3), -- Parts[Brand]\n REMOVEFILTERS(Parts[Type]))")
        .when(k % 5 == 1, "CALCULATE([M], USERELATIONSHIP(Parts[Size], Parts[Brand]))")
        .when(k % 5 == 2, 'CALCULATE([M], TREATAS(VALUES(Parts[Brand]), Parts[Type]), "Parts[Size]")')
        .when(k % 5 == 3, "SUMX(Parts, CROSSFILTER(Parts[Brand], Parts[Size], BOTH))")
        .otherwise("SUM(Parts[Size]) + IF(TRUE, 1, 2)")
    )
    return table(spark, d, "part").select(F.concat(F.lit("m:"), k.cast("string")).alias("id"), F.concat(F.lit("model:"), (k % 2).cast("string")).alias("model_id"), text.alias("formula"))


@query("""WITH m AS (SELECT 'm:' || p_partkey AS id, p_partkey % 5 AS kind, 'model:' || p_partkey % 2 AS model FROM part)
  SELECT id AS from_id, model || '/' || x AS to_id, 'MODIFIES_FILTER' AS type FROM (SELECT id, model, unnest(CASE kind WHEN 0 THEN ['table', 'Size', 'Type'] WHEN 1 THEN ['Size', 'Brand'] WHEN 2 THEN ['Type', 'Brand'] ELSE []::VARCHAR[] END) AS x FROM m)
  UNION ALL SELECT id, CASE WHEN model = 'model:0' THEN 'model:0/r1' END, CASE kind WHEN 1 THEN 'ACTIVATES_RELATIONSHIP' ELSE 'MODIFIES_RELATIONSHIP' END FROM m WHERE kind IN (1, 3)""")
def filter_links(spark, d) -> DataFrame:
    """Model 0 has one relationship between the two columns, model 1 two, so there none is meant."""
    models = spark.createDataFrame([("model:0",), ("model:1",)], "model_id string")
    at = lambda x: F.concat("model_id", F.lit(f"/{x}"))
    columns = models.select("model_id", F.explode(F.array(*map(F.lit, ["Size", "Brand", "Type"]))).alias("name")).select(F.concat("model_id", F.lit("/"), "name").alias("id"), "model_id", F.lit("parts").alias("table"), "name")
    tables = models.select(at("table").alias("id"), "model_id", F.lit("PARTS").alias("name"))
    one = models.select(at("r1").alias("id"), "model_id", at("Brand").alias("from_column_id"), at("Size").alias("to_column_id"))
    two = models.where("model_id = 'model:1'").select(at("r2").alias("id"), "model_id", at("Size").alias("from_column_id"), at("Brand").alias("to_column_id"))
    return formulas.filter_links(_measures(spark, d), columns, tables, one.union(two))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a,x' ELSE '' END AS variables FROM part""")
def formula_variables(spark, d) -> DataFrame:
    text = F.when(F.col(_K) % 2 == 0, 'VAR X = 1 // VAR z = 2\nvar a = "VAR q = 1"\nRETURN X + a').otherwise("SUM(Parts[VAR])")
    return table(spark, d, "part").select(_K, F.array_join(variables(text), ",").alias("variables"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Name,Size' END AS columns, CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 0 END AS rows FROM part""")
def literal_tables(spark, d) -> DataFrame:
    """Tables of constants; one with a reference, one with a short row and a plain formula are none."""
    k, name = F.col(_K) % 4, F.replace("p_name", F.lit('"'), F.lit('""'))
    body = lambda last: F.concat(F.lit('DataTable("Name", STRING, "Size", INTEGER, { {"'), name, F.lit(f'", -1.5 }} /* {{ }} */, {last} }} )'))
    text = F.when(k == 0, body('{"{x}", BLANK()}')).when(k == 1, body('{"x", Parts[Size]}')).when(k == 2, body('{"x"}')).otherwise("SUM(Parts[Size])")
    got = table(spark, d, "part").select(_K, literal_table(text).alias("t"))
    return got.select(_K, F.array_join("t.columns", ",").alias("columns"), F.coalesce("t.rows", F.lit(0)).alias("rows"))


@query("""SELECT 'q:' || p_partkey AS from_id, 's:' || x AS to_id FROM (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['Base Path', 'Server'] WHEN 1 THEN ['Server'] ELSE []::VARCHAR[] END) AS x FROM part)""")
def shared_expressions(spark, d) -> DataFrame:
    k = F.col(_K) % 3
    text = F.when(k == 0, 'let a = #"Base Path" & Server, b = "Port" in a').when(k == 1, "Server /* Port */ & 1 // Port").otherwise('"Server"')
    texts = table(spark, d, "part").select(F.concat(F.lit("q:"), F.col(_K).cast("string")).alias("id"), F.lit("m").alias("model_id"), text.alias("text"))
    shared = spark.createDataFrame([(f"s:{n}", "m", n) for n in ("Base Path", "Server", "Port")] + [("s:other", "n", "Server")], "id string, model_id string, name string")
    return formulas.shared_links(texts, shared)


@query("""WITH p AS (SELECT 'measure:' || p_partkey AS target, p_partkey % 4 AS k, p_name, p_type FROM part)
  SELECT target, 'BUSINESS_CONCEPT' AS assertion, 'Net sales by ' || p_type AS value, 'description' AS source, 1 AS priority FROM p WHERE k = 0
  UNION ALL SELECT target, 'ALIAS', p_name, 'description', 1 FROM p WHERE k = 0 UNION ALL SELECT target, 'ROLE', 'fact', 'description', 1 FROM p WHERE k = 0
  UNION ALL SELECT target, 'BUSINESS_CONCEPT', p_name, 'object_name', 5 FROM p WHERE k = 1 UNION ALL SELECT target, 'BEHAVIOR', 'SUM', 'dax_analysis', 2 FROM p WHERE k <> 2""")
def meaning_candidates(spark, d) -> DataFrame:
    """Described measures, named ones, generic ones and numbered ones."""
    k = F.col(_K) % 4
    rows = table(spark, d, "part").select(
        F.concat(F.lit("measure:"), F.col(_K).cast("string")).alias("id"), F.lit("MEASURE").alias("type"),
        F.when(k == 2, "Values").when(k == 3, "measure_12").otherwise(F.col("p_name")).alias("name"), F.when(k == 0, F.concat(F.lit(" Net sales by "), "p_type")).alias("description"),
        F.when(k != 2, F.array(F.lit("sum"), F.lit("SUM"))).alias("functions"),
    )
    return inference.candidates(rows)


@query("""SELECT p_partkey AS target, CASE p_partkey % 5 WHEN 0 THEN 'selector' WHEN 1 THEN 'filter_context' ELSE 'selector' END AS behaviour, CASE p_partkey % 5 WHEN 0 THEN 'declared_role' ELSE 'denied' END AS reason FROM part WHERE p_partkey % 5 IN (0, 1, 3)""")
def meaning_conflicts(spark, d) -> DataFrame:
    k = F.col(_K) % 5
    text = F.when(k == 0, "The customer dimension").when(k == 1, "This never changes any kind of Filter, ever").when(k == 2, "Filters rows; not a total").when(k == 3, "isn't meant as a selected value").otherwise("not one of the very many other things that select a filter")
    p = table(spark, d, "part")
    acts = F.when(k == 0, "selector").when(k == 3, "selector").otherwise("filter_context")
    return inference.conflicts(p.select(F.col(_K).alias("id"), text.alias("description")), p.select(F.col(_K).alias("id"), acts.alias("behaviour")))


@query("""SELECT p_partkey AS id, 'Parts[' || p_brand || ']' AS "column", CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '-1.5' END AS fallback FROM part""")
def selector_defaults(spark, d) -> DataFrame:
    text = F.when(F.col(_K) % 2 == 0, F.concat(F.lit("SWITCH(SelectedValue( Parts["), "p_brand", F.lit('] , "'), "p_type", F.lit('"), 1)'))).otherwise(F.concat(F.lit("SELECTEDVALUE(Parts["), "p_brand", F.lit("], -1.5) + SELECTEDVALUE(Parts[x])")))
    return inference.selected_defaults(table(spark, d, "part").select(F.col(_K).alias("id"), text.alias("formula")))


# --- inspection ------------------------------------------------------------------------------


@query(f"""WITH {CATALOG_SQL}, h AS (SELECT from_id AS id, to_id AS child FROM links WHERE type = 'CONTAINS'), b AS (SELECT id AS child, count(*) AS children FROM h GROUP BY 1),
  r AS (SELECT h.id, o.type AS kind, h.child, o.name, coalesce(children, 0) AS children, count(*) OVER (PARTITION BY h.id, o.type) AS n, row_number() OVER (PARTITION BY h.id, o.type ORDER BY lower(o.name), h.child) AS k
    FROM h JOIN objects o ON o.id = h.child LEFT JOIN b ON b.child = h.child WHERE h.id IN (SELECT id FROM objects WHERE type IN ('MODEL', 'REPORT', 'TABLE')))
  SELECT id, kind, child, name, children, n FROM r WHERE k <= 7""")
def held_objects(spark, d) -> DataFrame:
    o = objects(spark, d)
    return inspection.contents(o, links(spark, d), o.where("type IN ('MODEL', 'REPORT', 'TABLE')").select("id"), 7)


@query(f"""WITH {CATALOG_SQL}, s AS (SELECT from_id AS id, 'out' AS direction, type, to_id AS other FROM links UNION SELECT to_id, 'in', type, from_id FROM links),
  r AS (SELECT s.id, direction, s.type, o.type AS kind, other, row_number() OVER (PARTITION BY s.id, direction, s.type, o.type ORDER BY other) AS k FROM s JOIN objects o ON o.id = other WHERE s.id IN (SELECT id FROM objects WHERE type IN ('COLUMN', 'MEASURE')))
  SELECT id, direction, type, kind, count(*) AS n, string_agg(other, ',' ORDER BY other) FILTER (k <= 3) AS first FROM r GROUP BY 1, 2, 3, 4""")
def link_previews(spark, d) -> DataFrame:
    """Of every column and measure the first three neighbours each way, by link and kind."""
    o = objects(spark, d)
    return inspection.neighbourhood(o, links(spark, d), o.where("type IN ('COLUMN', 'MEASURE')").select("id")).withColumn("first", F.array_join("first", ","))


@query(f"""WITH {CATALOG_SQL}, o AS (SELECT * FROM objects WHERE type <> 'REPORT'), w AS (SELECT id FROM objects WHERE type IN ('REPORT', 'PAGE', 'TABLE'))
  SELECT 'missing_object' AS code, 'ERROR' AS severity, id AS object_id, NULL::VARCHAR AS edge_id, NULL::VARCHAR AS detail FROM w WHERE id NOT IN (SELECT id FROM o)
  UNION ALL SELECT 'missing_report_reference', 'ERROR', id, NULL, report_id FROM o WHERE type = 'PAGE' UNION ALL SELECT 'missing_parent_reference', 'ERROR', id, NULL, parent_id FROM o WHERE type = 'PAGE'""")
def selection_issues(spark, d) -> DataFrame:
    """Reports are gone: they are missing themselves, and their pages name them."""
    o = objects(spark, d)
    return inspection.selection(o.where("type <> 'REPORT'"), links(spark, d), o.where("type IN ('REPORT', 'PAGE', 'TABLE')").select("id"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, a.l_orderkey AS o FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY o) AS k, count(*) OVER (PARTITION BY a, b) AS together FROM p) SELECT a, b, together, string_agg(o, ',' ORDER BY o) AS examples FROM r WHERE together >= 4 AND k <= 5 GROUP BY 1, 2, 3""")
def co_occurring(spark, d) -> DataFrame:
    return inspection.co_occurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 4, 5).withColumn("examples", F.array_join("examples", ","))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS total, grouping(o_orderpriority)::TINYINT AS "all"
  FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def cross_tab_totals(spark, d) -> DataFrame:
    return inspection.cross_tab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


# --- small operators over whole tables -------------------------------------------------------


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g')) AS plain FROM documents""")
def plain_texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(plain_text(F.coalesce("text", F.lit(""))), 256).alias("plain"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'RELATIONSHIP|' || least(lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g'))) || '~' || greatest(lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')))
  ELSE 'MEASURE|' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '|' || lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) END AS key FROM part""")
def alignment_keys(spark, d) -> DataFrame:
    kind = F.when(F.col(_K) % 3 == 0, "RELATIONSHIP").otherwise("MEASURE")
    return table(spark, d, "part").select(_K, align.alignment_key(kind, F.col("p_brand"), F.col("p_name"), F.array("p_type", "p_brand")).alias("key"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'approved' ELSE 'FACT' END AS status FROM orders""")
def carried_statuses(spark, d) -> DataFrame:
    """Earlier decisions live on in a new scan."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    old = o.withColumn("status", F.when(F.col("id") % 4 == 0, "approved").otherwise("FACT"))
    return inference.carry_over(o.withColumn("status", F.lit("FACT")), old)


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def first_per_key(spark, d) -> DataFrame:
    """The first of each key after a total order, as a partial minimum instead of a sort."""
    rank = F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", rank).alias("o_orderkey"))


@query("""SELECT l_orderkey AS key, string_agg(l_partkey, ',' ORDER BY l_partkey) AS items FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE k <= 2 GROUP BY 1""")
def smallest_items(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("item")).distinct()
    return validation.smallest(rows, "key", "item", 2).withColumn("items", F.array_join("items", ","))
