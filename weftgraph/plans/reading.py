"""Model and report files written from the tables and read back, sinks and stores; registers with ``queries``."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import shared_folder
from weftgraph.operators import regression
from weftgraph.plans.queries import query
from weftgraph.sources import folders, metadata
from weftgraph.sources.catalog import CATALOG_SQL, links, objects
from weftgraph.sources.star import GRAPH_SQL, edges, nodes, table


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def _id(kind: str, c) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), c.cast("string"))


def _written_models(spark, d) -> DataFrame:
    """One file a region: nations as tables with columns, measures, a hierarchy and a partition; roles, groups and functions."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    columns = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct(_id("col", F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))).alias("columns"))
    p = table(spark, d, "part")
    measures = p.groupBy((F.col("p_partkey") % 25).cast("int").alias("n_nationkey")).agg(F.collect_list(F.struct(_id("mea", F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.lit("SUM(x)").alias("expression"))).alias("measures"))
    key = F.col("n_nationkey")
    levels = F.array(F.struct(_id("lev", key).alias("id"), F.lit("Top").alias("name"), _id("col", key).alias("column")))
    tables = n.join(columns, "n_nationkey", "left").join(measures, "n_nationkey", "left").groupBy("n_regionkey").agg(F.collect_list(F.struct(
        _id("tab", key).alias("id"), F.col("n_name").alias("name"), "columns", "measures",
        F.array(F.struct(_id("hie", key).alias("id"), F.lit("H").alias("name"), levels.alias("levels"))).alias("hierarchies"), F.array(F.struct(_id("par", key).alias("id"), F.lit("P").alias("name"), F.lit("let").alias("expression"))).alias("partitions"),
    )).alias("tables"))
    r = F.col("n_regionkey")
    permission = F.array(F.struct(_id("per", r).alias("id"), F.lit("F").alias("name"), _id("tab", r).alias("table"), F.lit("TRUE()").alias("filterExpression")))
    items = F.array(*[F.struct(F.concat(_id("ite", r), F.lit(f"-{i}")).alias("id"), F.lit(str(i)).alias("name"), F.lit("SELECTEDMEASURE()").alias("expression")) for i in range(2)])
    model = tables.select(
        _id("mod", r).alias("id"), _id("Model", r).alias("name"), "tables", F.array(F.struct(_id("rol", r).alias("id"), F.lit("R").alias("name"), permission.alias("tablePermissions"))).alias("roles"),
        F.array(F.struct(_id("grp", r).alias("id"), F.lit("G").alias("name"), items.alias("calculationItems"))).alias("calculationGroups"), F.array(F.struct(_id("fun", r).alias("id"), F.lit("f").alias("name"), F.lit("x").alias("expression"))).alias("userDefinedFunctions"),
    )
    path = _folder(spark, "models")
    model.select(F.to_json(F.struct(*model.columns)).alias("value")).repartition(F.col("value")).write.text(path)
    # one object a line here; files of one object or an array are read with multiLine
    return spark.read.schema(metadata.MODEL).json(path)


@query("""SELECT 'MODEL' AS type, 5 AS n, 0 AS parents FROM (SELECT 1) WHERE (SELECT count(*) FROM nation) > 0 UNION ALL SELECT 'TABLE', count(*), count(*) FROM nation UNION ALL SELECT 'COLUMN', count(*), count(*) FROM supplier
  UNION ALL SELECT 'MEASURE', count(*), count(*) FROM part UNION ALL SELECT unnest(['HIERARCHY', 'LEVEL', 'PARTITION']), count(*), count(*) FROM nation
  UNION ALL SELECT unnest(['SECURITY_ROLE', 'ROLE_FILTER', 'CALCULATION_GROUP', 'USER_DEFINED_FUNCTION']), count(*), count(*) FROM region UNION ALL SELECT 'CALCULATION_ITEM', 2 * count(*), 2 * count(*) FROM region""")
def read_models(spark, d) -> DataFrame:
    """Objects by type of model files, and how many hang on a parent."""
    n = metadata.model_nodes(_written_models(spark, d))
    return n.groupBy("type").agg(F.countDistinct("id").alias("n"), F.count("parent_id").alias("parents"))


def _written_reports(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    key = lambda kind: _id(kind, F.col("c_custkey"))
    target = lambda to: F.struct(to.alias("objectId"))
    visual = F.struct(
        key("vis").alias("id"), F.col("c_name").alias("title"), F.lit("card").alias("visualType"), F.array(F.struct(_id("col", F.col("c_custkey") % 7).alias("objectId"))).alias("fields"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.struct(key("vf").alias("id"), F.lit("x > 1").alias("condition"), target(_id("col", F.col("c_custkey") % 5)).alias("target")))).alias("filters"),
    )
    page = _id("pag", F.col("c_nationkey"))
    pages = c.groupBy("c_mktsegment", "c_nationkey").agg(F.collect_list(visual).alias("visualContainers"))
    of = F.concat(page, F.lit("-"), "c_mktsegment")
    section = F.struct(of.alias("id"), of.alias("displayName"), F.array(F.struct(F.concat(F.lit("pf:"), of).alias("id"), target(F.lit("col:1")).alias("target"))).alias("filters"), "visualContainers")
    reports = pages.groupBy("c_mktsegment").agg(F.collect_list(section).alias("sections"))
    own = F.concat(F.lit("rep:"), "c_mktsegment")
    report = reports.select(own.alias("id"), F.col("c_mktsegment").alias("name"), F.lit("mod:0").alias("modelId"), "sections", F.array(F.struct(F.concat(F.lit("bm:"), "c_mktsegment").alias("id"), F.lit("B").alias("displayName"))).alias("bookmarks"))
    path = _folder(spark, "reports")
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.text(path)
    return spark.read.schema(metadata.REPORT).json(path)


@query("""WITH p AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), s AS (SELECT DISTINCT c_mktsegment FROM customer)
  SELECT 'REPORT' AS kind, count(*) AS n FROM s UNION ALL SELECT 'BOOKMARK', count(*) FROM s UNION ALL SELECT 'PAGE', count(*) FROM p UNION ALL SELECT 'PAGE_FILTER', count(*) FROM p UNION ALL SELECT 'VISUAL', count(*) FROM customer
  UNION ALL SELECT 'VISUAL_FILTER', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'USES', count(*) FROM customer UNION ALL SELECT 'USES_MODEL', count(*) FROM s
  UNION ALL SELECT 'FILTERS', (SELECT count(*) FROM p) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0)""")
def read_reports(spark, d) -> DataFrame:
    """Objects and links by type of report files."""
    r = _written_reports(spark, d)
    n = metadata.report_nodes(r).select(F.col("type").alias("kind"), "id")
    e = metadata.usage(r).union(metadata.filter_targets(r)).select(F.col("type").alias("kind"), F.concat_ws("|", "from_id", "to_id").alias("id"))
    return n.union(e).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH_SQL} SELECT type, count(*) AS n, count(*) AS same FROM nodes GROUP BY type")
def stored_table(spark, d) -> DataFrame:
    """A store replaced as a whole, twice: readers see the last version, by scan, by key and as a count."""
    path, n = _folder(spark, "store"), nodes(spark, d)
    folders.replace_table(n.where("type <> 'PART'"), path)
    folders.replace_table(n, path)
    back = folders.read_table(spark, path)
    both = n.select("id", "type").join(back.select("id", F.lit(True).alias("there")), "id", "left")
    return both.groupBy("type").agg(F.count("*").alias("n"), F.count("there").alias("same"))


@query(f"WITH {GRAPH_SQL} SELECT id, type, name FROM nodes WHERE id IN ('nation:3', 'part:7', 'order:1')")
def point_read(spark, d) -> DataFrame:
    """Objects by key from a stored table; the keys reach the scan."""
    path = _folder(spark, "store")
    folders.replace_table(nodes(spark, d), path)
    return folders.read_table(spark, path).where(F.col("id").isin("nation:3", "part:7", "order:1")).select("id", "type", "name")


@query(f"WITH {GRAPH_SQL} SELECT id, type, name, model_id FROM nodes")
def canonical_round_trip(spark, d) -> DataFrame:
    path = f"{_folder(spark, 'canonical')}"
    metadata.write_canonical(nodes(spark, d), path)
    return metadata.read_canonical(spark, path, "id string, type string, name string, model_id string")


@query("""SELECT count(*) AS files, true AS same_content, false AS changed_alike FROM (SELECT 1)""")
def snapshot_identity(spark, d) -> DataFrame:
    """The same rows in another order have one content id, other rows another; the manifest has one file."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    path = _folder(spark, "manifest")
    o.coalesce(1).write.json(path)
    ids = [metadata.content_id(x).first()["content_id"] for x in (o, o.orderBy(F.desc("o_orderkey")).select("o_orderstatus", "o_orderkey"), o.where("o_orderkey > 1"))]
    return metadata.manifest(spark, path).agg(F.count("*").alias("files")).select("files", F.lit(ids[0] == ids[1]).alias("same_content"), F.lit(ids[0] == ids[2]).alias("changed_alike"))


@query(f"""WITH {CATALOG_SQL}, l AS (SELECT 'measure|' || lower(name) AS key, id, type FROM objects WHERE type = 'MEASURE' UNION ALL SELECT lower(type) || '|' || lower(name), id, type FROM objects WHERE type <> 'MEASURE')
  SELECT key, count(*) AS n, min(id) AS first FROM l GROUP BY key""")
def ask_index(spark, d) -> DataFrame:
    """The index behind questions: names by type, with how many objects bear them."""
    return metadata.ask_index(objects(spark, d))


@query(f"""WITH {CATALOG_SQL}, f AS (SELECT a.type AS from_type, l.type, b.type AS to_type FROM links l JOIN objects a ON a.id = from_id JOIN objects b ON b.id = to_id) SELECT from_type, type, to_type, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def wiring(spark, d) -> DataFrame:
    """Which types are linked with which, and how often."""
    return metadata.wiring(objects(spark, d), links(spark, d))


@query(f"WITH {GRAPH_SQL}, e AS (SELECT DISTINCT from_id, to_id, type FROM edges) SELECT count(*) AS placed, min(place) AS first, max(place) AS last FROM (SELECT row_number() OVER (ORDER BY from_id, to_id, type) AS place FROM e)")
def placed_edges(spark, d) -> DataFrame:
    rows = regression.placed(edges(spark, d).select("from_id", "to_id", "type").distinct(), ["from_id", "to_id", "type"])
    return rows.agg(F.countDistinct("place").alias("placed"), F.min("place").alias("first"), F.max("place").alias("last"))
