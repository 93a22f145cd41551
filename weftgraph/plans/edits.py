"""Change plan and overview queries; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import edits
from weftgraph.plans.queries import query
from weftgraph.sources.star import GRAPH_SQL, edges, nodes, table


@query("""WITH m AS (SELECT p_brand, unnest(['COLUMN', 'MEASURE', 'ROLE', 'MEASURE']) AS kind, unnest(['description', 'formula', 'name', 'data_source']) AS prop, unnest([0, 1, 2, 3]) AS k, p_partkey FROM part),
  r AS (SELECT p_brand, CASE WHEN kind = 'ROLE' OR contains(prop, 'source') THEN 3 WHEN prop = 'description' THEN 0 WHEN kind = 'COLUMN' THEN 2 ELSE 1 END AS level FROM m WHERE p_partkey % 4 = k AND p_partkey % 4 < (CASE WHEN p_brand < 'Brand#3' THEN 2 ELSE 4 END))
  SELECT p_brand, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(level) + 1] AS risk, count(*) AS changes FROM r GROUP BY p_brand""")
def change_risk(spark, d) -> DataFrame:
    k, pick = F.col("p_partkey") % 4, lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "part").where(k < F.when(F.col("p_brand") < "Brand#3", 2).otherwise(4))
    level = edits.risk(pick("COLUMN", "MEASURE", "ROLE", "MEASURE"), pick("description", "formula", "name", "data_source"))
    return rows.select("p_brand", level.alias("level")).groupBy("p_brand").agg(edits.highest(F.col("level")).alias("risk"), F.count("*").alias("changes"))


@query("""WITH a AS (SELECT p_partkey AS id, p_brand, p_name AS name, regexp_replace(p_name, '^[A-Za-z]+ ', '') AS new_name FROM part), t AS (SELECT p_brand, lower(new_name) AS k, count(*) AS n FROM a GROUP BY 1, 2)
  SELECT id, name, new_name, n > 1 AS clash FROM a JOIN t ON a.p_brand = t.p_brand AND lower(a.new_name) = t.k WHERE name <> new_name""")
def rename_preview(spark, d) -> DataFrame:
    return edits.rename_preview(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand"), "^[A-Za-z]+ ", "", ["p_brand"])


@query("""SELECT p_type AS name, count(DISTINCT p_size) AS variants FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1""")
def donor_conflicts(spark, d) -> DataFrame:
    return edits.disagreeing(table(spark, d, "part").select(F.col("p_type").alias("name"), "p_size"), "name", "p_size")


@query("""WITH u AS (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
  SELECT p_partkey AS item, coalesce(n, 0) AS dependents, CASE WHEN n IS NULL THEN 'remove' WHEN p_partkey % 3 = 0 THEN 'blocked' WHEN p_partkey % 3 = 1 THEN 'remove_all' ELSE 'repoint' END AS result FROM part LEFT JOIN u ON item = p_partkey WHERE p_size <= 10""")
def removal_policies(spark, d) -> DataFrame:
    uses = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("item"))
    policy = F.element_at(F.array(F.lit("block"), F.lit("cascade"), F.lit("repoint")), (F.col("item") % 3 + 1).cast("int"))
    return edits.outcome(table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("item")), uses, policy)


@query(f"""WITH {GRAPH_SQL}, o AS (SELECT from_id AS id, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT to_id AS id, count(*) AS n, count(*) FILTER (type <> 'CONTAINS') AS used FROM edges GROUP BY 1)
  SELECT type, count(*) AS objects, count(*) FILTER (o.id IS NULL AND i.id IS NULL) AS alone, coalesce(sum(o.n), 0)::BIGINT AS out_edges, coalesce(sum(i.n), 0)::BIGINT AS in_edges, coalesce(max(i.used), 0) AS most_used FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id) GROUP BY type""")
def overview(spark, d) -> DataFrame:
    """Objects and edges by type, from one scan of the edges and one shuffle on the id."""
    end = lambda c, out: F.struct(F.col(c).alias("id"), F.lit(out).alias("out"), (F.lit(1 - out) * (F.col("type") != "CONTAINS").cast("int")).alias("used"))
    ends = edges(spark, d).select(F.explode(F.array(end("from_id", 1), end("to_id", 0))).alias("e")).select("e.*")
    degree = ends.groupBy("id").agg(F.sum("out").alias("outs"), F.sum(1 - F.col("out")).alias("ins"), F.sum("used").alias("used"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return nodes(spark, d).join(degree, "id", "left").groupBy("type").agg(
        F.count("*").alias("objects"), F.count_if(F.col("outs").isNull()).alias("alone"), zero(F.sum("outs")).alias("out_edges"), zero(F.sum("ins")).alias("in_edges"), zero(F.max("used")).alias("most_used"),
    )


@query(f"""WITH {GRAPH_SQL}, c AS (SELECT e.from_id AS id, n.type AS kind, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.to_id WHERE e.type = 'CONTAINS' GROUP BY 1, 2)
  SELECT id, name, kind, n FROM nodes JOIN c USING (id)""")
def contents(spark, d) -> DataFrame:
    """What every container holds, by kind."""
    every = nodes(spark, d)
    held = edges(spark, d).where("type = 'CONTAINS'").join(every.select(F.col("id").alias("to_id"), F.col("type").alias("kind")), "to_id")
    return held.groupBy(F.col("from_id").alias("id"), "kind").agg(F.count("*").alias("n")).join(every.select("id", "name"), "id").select("id", "name", "kind", "n")
