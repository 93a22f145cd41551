"""A metadata graph (models, tables, columns, measures, reports, pages, visuals) as a view over the star-schema tables, and its SQL twin.

Regions are models, nations their tables, suppliers columns, parts measures; every market segment of
a region is a report, its nations are the pages and its customers the visuals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.star import table


def _key(kind: str, *keys) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("-", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


COLUMNS = ["id", "type", "name", "description", "model_id", "report_id", "source_id", "parent_id", "status", "display_folder", "expression"]


def objects(spark: SparkSession, d: str) -> DataFrame:
    """(id, type, name, description, model_id, report_id, source_id, parent_id, status, display_folder, expression)."""
    t = lambda n: table(spark, d, n)
    nation, none, factual = t("nation"), F.lit(None).cast("string"), F.lit("factual")
    model = _key("model", "n_regionkey")
    homes = nation.select(F.col("n_nationkey").alias("home"), "n_regionkey", "n_name")
    pages = t("customer").join(homes, F.col("c_nationkey") == F.col("home")).select("c_mktsegment", "n_regionkey", "home", "n_name").distinct()
    report = _key("report", "c_mktsegment", "n_regionkey")
    measure_home = (F.col("p_partkey") % 25).cast("int")
    k = F.col("p_partkey").cast("string")
    parts = [
        t("region").select(_key("model", "r_regionkey"), F.lit("MODEL"), "r_name", none, _key("model", "r_regionkey"), none, none, none, factual, none, none),
        nation.select(_key("table", "n_nationkey"), F.lit("TABLE"), "n_name", none, model, none, _key("src", "n_nationkey"), model, factual, none, none),
        t("supplier").join(homes, F.col("s_nationkey") == F.col("home")).select(_key("column", "s_suppkey"), F.lit("COLUMN"), "s_name", none, model, none, none, _key("table", "s_nationkey"), factual, none, none),
        t("part").join(homes, measure_home == F.col("home")).select(
            _key("measure", "p_partkey"), F.lit("MEASURE"), "p_name", "p_type", model, none, none, _key("table", measure_home),
            F.when(F.col("p_partkey") % 10 == 0, "candidate").otherwise("factual"), "p_brand", F.concat(F.lit("SUM([M"), k, F.lit("])")),
        ),
        pages.select("c_mktsegment", "n_regionkey").distinct().select(report, F.lit("REPORT"), "c_mktsegment", none, model, report, none, none, factual, none, none),
        pages.select(_key("page", "c_mktsegment", "home"), F.lit("PAGE"), F.concat("c_mktsegment", F.lit(" "), "n_name"), none, model, report, none, report, factual, none, none),
        t("customer").join(homes, F.col("c_nationkey") == F.col("home")).select(_key("visual", "c_custkey"), F.lit("VISUAL"), "c_name", none, model, report, none, _key("page", "c_mktsegment", "home"), factual, none, none),
    ]
    return reduce(DataFrame.union, parts).toDF(*COLUMNS)


def links(spark: SparkSession, d: str) -> DataFrame:
    """(id, type, from_id, to_id, source, confidence, status, evidence_class, evidence)."""
    t = lambda n: table(spark, d, n)
    held = objects(spark, d).where("parent_id IS NOT NULL").select(F.lit("CONTAINS").alias("type"), F.col("parent_id").alias("from_id"), F.col("id").alias("to_id"))
    lines = t("lineitem")
    reads = lines.select("l_partkey", "l_suppkey").distinct().select(F.lit("REFERENCES"), _key("measure", "l_partkey"), _key("column", "l_suppkey"))
    needs = t("part").where("p_partkey > 1").select(F.lit("DEPENDS_ON"), _key("measure", "p_partkey"), _key("measure", F.floor(F.col("p_partkey") / 2)))
    uses = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct().select(F.lit("USES"), _key("visual", "o_custkey"), _key("measure", "l_partkey"))
    guessed = (F.col("type") == "DEPENDS_ON") & F.col("from_id").endswith("0")
    every = held.union(reads).union(needs).union(uses)
    return every.select(
        F.concat_ws("|", "type", "from_id", "to_id").alias("id"), "type", "from_id", "to_id", F.lit("scan").alias("source"), F.when(guessed, 0.6).otherwise(1.0).alias("confidence"),
        F.when(guessed, "candidate").otherwise("factual").alias("status"), F.when(guessed, "INFERRED").otherwise("FACT").alias("evidence_class"), F.array(F.lit("metadata")).alias("evidence"),
    )


_REPORT = "'report:' || c_mktsegment || '-' || n_regionkey"
CATALOG_SQL = f"""
pages_of AS (SELECT DISTINCT c_mktsegment, n_regionkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
objects AS (
  SELECT 'model:' || r_regionkey AS id, 'MODEL' AS type, r_name AS name, NULL::VARCHAR AS description, 'model:' || r_regionkey AS model_id, NULL::VARCHAR AS report_id,
    NULL::VARCHAR AS source_id, NULL::VARCHAR AS parent_id, 'factual' AS status, NULL::VARCHAR AS display_folder, NULL::VARCHAR AS expression FROM region
  UNION ALL SELECT 'table:' || n_nationkey, 'TABLE', n_name, NULL, 'model:' || n_regionkey, NULL, 'src:' || n_nationkey, 'model:' || n_regionkey, 'factual', NULL, NULL FROM nation
  UNION ALL SELECT 'column:' || s_suppkey, 'COLUMN', s_name, NULL, 'model:' || n_regionkey, NULL, NULL, 'table:' || s_nationkey, 'factual', NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'measure:' || p_partkey, 'MEASURE', p_name, p_type, 'model:' || n_regionkey, NULL, NULL, 'table:' || (p_partkey % 25),
    CASE WHEN p_partkey % 10 = 0 THEN 'candidate' ELSE 'factual' END, p_brand, 'SUM([M' || p_partkey || '])' FROM part JOIN nation ON p_partkey % 25 = n_nationkey
  UNION ALL SELECT DISTINCT {_REPORT}, 'REPORT', c_mktsegment, NULL, 'model:' || n_regionkey, {_REPORT}, NULL, NULL, 'factual', NULL, NULL FROM pages_of
  UNION ALL SELECT 'page:' || c_mktsegment || '-' || n_nationkey, 'PAGE', c_mktsegment || ' ' || n_name, NULL, 'model:' || n_regionkey, {_REPORT}, NULL, {_REPORT}, 'factual', NULL, NULL FROM pages_of
  UNION ALL SELECT 'visual:' || c_custkey, 'VISUAL', c_name, NULL, 'model:' || n_regionkey, {_REPORT}, NULL, 'page:' || c_mktsegment || '-' || n_nationkey, 'factual', NULL, NULL
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
plain_links AS (
  SELECT 'CONTAINS' AS type, parent_id AS from_id, id AS to_id FROM objects WHERE parent_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'REFERENCES', 'measure:' || l_partkey, 'column:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'DEPENDS_ON', 'measure:' || p_partkey, 'measure:' || (p_partkey // 2) FROM part WHERE p_partkey > 1
  UNION ALL SELECT DISTINCT 'USES', 'visual:' || o_custkey, 'measure:' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
links AS (
  SELECT type || '|' || from_id || '|' || to_id AS id, type, from_id, to_id, 'scan' AS source,
    CASE WHEN type = 'DEPENDS_ON' AND from_id LIKE '%0' THEN 0.6 ELSE 1.0 END AS confidence,
    CASE WHEN type = 'DEPENDS_ON' AND from_id LIKE '%0' THEN 'candidate' ELSE 'factual' END AS status,
    CASE WHEN type = 'DEPENDS_ON' AND from_id LIKE '%0' THEN 'INFERRED' ELSE 'FACT' END AS evidence_class, ['metadata'] AS evidence FROM plain_links)
"""
