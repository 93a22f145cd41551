"""The property graph as a view over the star-schema tables, and its SQL twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, name, model_id) of regions, nations, customers, suppliers, parts and orders."""
    t = lambda n: table(spark, sf_dir, n)
    home = t("nation").select(F.col("n_nationkey"), _id("region", "n_regionkey").alias("model_id"))
    none = F.lit(None).cast("string")
    parts = [
        t("region").select(_id("region", "r_regionkey").alias("id"), F.lit("REGION").alias("type"), F.col("r_name").alias("name"), _id("region", "r_regionkey").alias("model_id")),
        t("nation").select(_id("nation", "n_nationkey"), F.lit("NATION"), "n_name", _id("region", "n_regionkey")),
        t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(_id("customer", "c_custkey"), F.lit("CUSTOMER"), "c_name", "model_id"),
        t("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(_id("supplier", "s_suppkey"), F.lit("SUPPLIER"), "s_name", "model_id"),
        t("part").select(_id("part", "p_partkey"), F.lit("PART"), "p_name", none),
        t("orders").select(_id("order", "o_orderkey"), F.lit("ORDER"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), none),
    ]
    return reduce(DataFrame.union, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, to_id, type) over the same tables."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem")
    parts = [
        t("nation").select(_id("region", "n_regionkey").alias("from_id"), _id("nation", "n_nationkey").alias("to_id"), F.lit("CONTAINS").alias("type")),
        t("customer").select(_id("nation", "c_nationkey"), _id("customer", "c_custkey"), F.lit("CONTAINS")),
        t("supplier").select(_id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), F.lit("CONTAINS")),
        t("orders").select(_id("order", "o_orderkey"), _id("customer", "o_custkey"), F.lit("DEPENDS_ON")),
        lines.select("l_orderkey", "l_partkey").distinct().select(_id("order", "l_orderkey"), _id("part", "l_partkey"), F.lit("USES")),
        lines.select("l_partkey", "l_suppkey").distinct().select(_id("part", "l_partkey"), _id("supplier", "l_suppkey"), F.lit("REFERENCES")),
    ]
    return reduce(DataFrame.union, parts)


GRAPH_SQL = """
home AS (SELECT n_nationkey, 'region:' || n_regionkey AS model_id FROM nation),
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'REGION' AS type, r_name AS name, 'region:' || r_regionkey AS model_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'NATION', n_name, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'CUSTOMER', c_name, model_id FROM customer LEFT JOIN home ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'SUPPLIER', s_name, model_id FROM supplier LEFT JOIN home ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'PART', p_name, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'ORDER', 'Order ' || o_orderkey, NULL FROM orders),
edges AS (
  SELECT 'region:' || n_regionkey AS from_id, 'nation:' || n_nationkey AS to_id, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'DEPENDS_ON' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'USES' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'REFERENCES' FROM lineitem)
"""


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, model_id, name, formula): one measure per part, its brand as the model; every kind of reference occurs."""
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    formula = (
        F.when(k % 4 == 0, "SUM('Part'[size])")
        .when(k % 4 == 1, text("// [M1]\nCALCULATE([M", (k - 1).cast("string"), "], FILTER(ALL(Part), Part[brand] = \"[x]\"))"))
        .when(k % 4 == 2, text("IF(HASONEVALUE(Part[type]), [m", (k - 1).cast("string"), "], [Missing])"))
        .otherwise(text("SWITCH(SELECTEDVALUE(Part[brand]), \"[M1]\", [M", (k - 2).cast("string"), "]) -- [M2]"))
    )
    return table(spark, sf_dir, "part").select(F.concat(F.lit("measure:"), k.cast("string")).alias("id"), F.concat(F.lit("model:"), (k % 40 < 20).cast("string")).alias("model_id"), F.concat(F.lit("M"), k.cast("string")).alias("name"), formula.alias("formula"))


FORMULA_SQL = """
formulas AS (SELECT 'measure:' || p_partkey AS id, 'model:' || (p_partkey % 40 < 20) AS model_id, 'M' || p_partkey AS name, CASE p_partkey % 4
  WHEN 0 THEN 'SUM(''Part''[size])'
  WHEN 1 THEN '// [M1]' || chr(10) || 'CALCULATE([M' || (p_partkey - 1) || '], FILTER(ALL(Part), Part[brand] = "[x]"))'
  WHEN 2 THEN 'IF(HASONEVALUE(Part[type]), [m' || (p_partkey - 1) || '], [Missing])'
  ELSE 'SWITCH(SELECTEDVALUE(Part[brand]), "[M1]", [M' || (p_partkey - 2) || ']) -- [M2]' END AS formula FROM part)
"""
