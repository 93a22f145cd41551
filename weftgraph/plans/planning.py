"""Plan queries: choices, removals, clashes, order, edits and gates; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import planning
from weftgraph.plans.queries import query
from weftgraph.sources.catalog import CATALOG_SQL, links, objects
from weftgraph.sources.star import table

_K = "p_partkey"


@query("""WITH c AS (SELECT 'r' || p_partkey AS row_key, p_partkey AS k, ['keep', 'take', 'take_properties', 'add_new_name', 'remove', 'promote', 'edit', 'fly'][p_partkey % 8 + 1] AS choice,
    CASE p_partkey % 5 WHEN 0 THEN 'gone' WHEN 1 THEN 't' ELSE 'a' END AS source_id, p_size FROM part)
  SELECT row_key, choice, source_id, CASE
    WHEN choice IN ('take', 'take_properties', 'add_new_name', 'promote') AND source_id = 'gone' THEN 'choice_source_removed' WHEN choice = 'fly' THEN 'unknown_kind'
    WHEN choice IN ('take', 'take_properties', 'add_new_name', 'promote') AND source_id = 'a' AND p_size % 2 = 0 THEN 'no_source_object'
    WHEN choice IN ('take', 'take_properties', 'add_new_name') AND source_id = 't' THEN 'source_is_target' WHEN choice IN ('take_properties', 'remove', 'edit') AND p_size % 3 = 0 THEN 'no_target_object'
    WHEN choice = 'take_properties' AND k % 7 = 0 THEN 'no_properties' WHEN choice = 'add_new_name' AND k % 2 = 1 THEN 'new_name_required' WHEN choice = 'promote' THEN 'report_measure_only' END AS reason
  FROM c WHERE choice <> 'keep'""")
def plan_choices(spark, d) -> DataFrame:
    """Choices on rows, possible or not; a new name is missing everywhere here, as its rows are odd ones."""
    p, k = table(spark, d, "part"), F.col(_K)
    key = F.concat(F.lit("r"), k.cast("string")).alias("row_key")
    held = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("t"))).otherwise(F.array(F.lit("a"), F.lit("t")))
    rows = p.select(key, F.lit("measure").alias("object_type"), (F.col("p_size") % 3 != 0).alias("in_target"), held.alias("sources"))
    kind = F.element_at(F.array(*map(F.lit, ["keep", "take", "take_properties", "add_new_name", "remove", "promote", "edit", "fly"])), (k % 8 + 1).cast("int"))
    source = F.when(k % 5 == 0, "gone").when(k % 5 == 1, "t").otherwise("a")
    choices = p.select(key, kind.alias("choice"), source.alias("source_id"), F.when(k % 7 != 0, F.array(F.lit("expression"))).alias("properties"), F.when(k % 2 == 0, "New").alias("new_name"))
    return planning.judged_choices(rows, choices, ["a", "t"], "t")


_REMOVED_SQL = f"""{CATALOG_SQL}, u AS (SELECT DISTINCT to_id AS id, from_id AS owner FROM links WHERE type IN ('DEPENDS_ON', 'REFERENCES')), f AS (SELECT DISTINCT to_id AS id, from_id AS owner FROM links WHERE type = 'USES'),
  kept AS (SELECT id FROM objects WHERE id LIKE 'measure:%7'),
  steps AS (SELECT parent_id AS id, id AS next, false AS use FROM objects WHERE parent_id IS NOT NULL UNION ALL SELECT id, owner, true FROM u WHERE owner NOT IN (SELECT id FROM kept)),
  gone AS (SELECT id, id AS because, 'cascade' AS policy FROM objects WHERE id = 'column:1' UNION SELECT id, id, 'block' FROM objects WHERE id = 'table:2' UNION SELECT id, id, 'repoint' FROM objects WHERE id = 'column:2'
    UNION SELECT s.next, g.because, g.policy FROM gone g JOIN steps s ON s.id = g.id AND (g.policy = 'cascade' OR NOT s.use))"""


@query(f"""WITH RECURSIVE {_REMOVED_SQL}, ids AS (SELECT DISTINCT id FROM gone)
  SELECT 'deleted' AS what, type, count(*) AS n, min(id) AS first FROM ids JOIN objects USING (id) GROUP BY 1, 2""")
def planned_deletions(spark, d) -> DataFrame:
    """A column goes with all that reads it, a table with its parts, another column is read elsewhere from now on."""
    o, _, told = _removals(spark, d)
    return told["deleted"].join(o.select("id", "type"), "id").groupBy(F.lit("deleted").alias("what"), "type").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def _removals(spark, d):
    o, e = objects(spark, d), links(spark, d)
    side = lambda *types: e.where(F.col("type").isin(*types)).select(F.col("to_id").alias("id"), F.col("from_id").alias("owner"))
    removed = spark.createDataFrame([("column:1", "cascade", None), ("table:2", "block", None), ("column:2", "repoint", "column:3")], "id string, policy string, repoint string")
    removed = removed.join(o.select("id"), "id", "left_semi")
    return o, e, planning.removals(o.select("id", "parent_id"), side("DEPENDS_ON", "REFERENCES"), side("USES"), removed, o.where("id LIKE 'measure:%7'").select("id"))


@query(f"""WITH RECURSIVE {CATALOG_SQL}, u AS (SELECT DISTINCT to_id AS id, from_id AS owner, type = 'USES' AS field FROM links WHERE type IN ('DEPENDS_ON', 'REFERENCES', 'USES')),
  gone AS (SELECT id FROM objects WHERE id = 'table:2' UNION SELECT o.id FROM gone g JOIN objects o ON o.parent_id = g.id)
  SELECT DISTINCT owner AS id, u.id AS removed, 'block' AS policy FROM u JOIN gone USING (id) WHERE owner NOT IN (SELECT id FROM gone) AND (field OR owner NOT LIKE 'measure:%7')""")
def blocked_removals(spark, d) -> DataFrame:
    """What still uses parts of a table that is to go."""
    o, e = objects(spark, d), links(spark, d)
    side = lambda *types: e.where(F.col("type").isin(*types)).select(F.col("to_id").alias("id"), F.col("from_id").alias("owner"))
    removed = spark.createDataFrame([("table:2", "repoint", None)], "id string, policy string, repoint string")
    return planning.removals(o.select("id", "parent_id"), side("DEPENDS_ON", "REFERENCES"), side("USES"), removed, o.where("id LIKE 'measure:%7'").select("id"))["blocked"]


@query("""WITH n AS (SELECT p_partkey AS id, p_brand, lower(CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END) AS k, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS name, p_partkey % 3 = 0 AND lower(split_part(p_name, ' ', 1)) <> lower(p_name) AS changed FROM part WHERE p_partkey % 10 <> 0
    UNION ALL SELECT -p_partkey, p_brand, lower(p_name), p_name, true FROM part WHERE p_partkey % 50 = 1), c AS (SELECT p_brand, k, count(*) AS n FROM n GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT id, name, c.n - 1 AS others FROM n JOIN c USING (p_brand, k) WHERE changed""")
def planned_name_clashes(spark, d) -> DataFrame:
    p, k = table(spark, d, "part"), F.col(_K)
    own = p.select(k.alias("id"), F.col("p_name").alias("name"), "p_brand")
    new = p.where(k % 3 == 0).select(k.alias("id"), F.substring_index("p_name", " ", 1).alias("new_name"))
    created = p.where(k % 50 == 1).select((-k).alias("id"), F.col("p_name").alias("name"), "p_brand")
    return planning.name_clashes(own, own.where("id % 10 = 0"), new, created, ["p_brand"])


_OPS = ["DELETE", "RENAME", "CREATE", "REPLACE", "REWRITE_EXPRESSION"]


@query(f"""WITH RECURSIVE o AS (SELECT 'op' || lpad(p_partkey::VARCHAR, 9, '0') AS id, p_partkey AS k, p_partkey % 5 AS phase, {_OPS}[p_partkey % 5 + 1] AS op, CASE WHEN p_size % 2 = 0 THEN 7 ELSE 2 END AS rank, p_brand || '-' || p_partkey AS object_id FROM part),
  need AS (SELECT a.id AS f, b.id AS t, a.phase FROM o a JOIN o b ON b.k = a.k // 10 * 5 + a.phase AND b.phase = a.phase AND a.k > b.k),
  e AS (SELECT CASE WHEN phase = 0 THEN f ELSE t END AS f, CASE WHEN phase = 0 THEN t ELSE f END AS t FROM need),
  w AS (SELECT id, 0 AS layer FROM o UNION SELECT e.t, layer + 1 FROM w JOIN e ON e.f = w.id),
  l AS (SELECT id, max(layer) AS layer FROM w GROUP BY id)
  SELECT row_number() OVER (ORDER BY phase, layer, rank, object_id, id) AS place, id AS operation_id, op, false AS cyclic FROM o JOIN l USING (id)""")
def plan_order(spark, d) -> DataFrame:
    p, k = table(spark, d, "part"), F.col(_K)
    name = lambda c: F.concat(F.lit("op"), F.lpad(c.cast("string"), 9, "0"))
    op = F.element_at(F.array(*map(F.lit, _OPS)), (k % 5 + 1).cast("int"))
    ops = p.select(name(k).alias("operation_id"), F.lit("model").alias("domain"), op.alias("op"), F.when(F.col("p_size") % 2 == 0, "measure").otherwise("column").alias("object_type"), F.concat("p_brand", F.lit("-"), k.cast("string")).alias("object_id"))
    needed = F.floor(k / 10) * 5 + k % 5
    needs = p.where((needed < k) & (needed >= 0)).select(name(k).alias("operation_id"), name(needed).alias("needed"))
    return planning.ordered(ops, needs)


@query("""SELECT p_partkey AS id, 'display_folder' AS property, p_brand AS old, CASE WHEN p_partkey % 2 = 0 AND p_brand <> 'Brand#11' THEN 'Brand#11' END AS new, CASE WHEN p_partkey % 2 = 1 THEN 'no_folder' WHEN p_brand = 'Brand#11' THEN 'no_change' END AS skipped FROM part
  UNION ALL SELECT p_partkey, 'description', p_type, NULL, NULL FROM part UNION ALL SELECT p_partkey, '$object', p_partkey::VARCHAR, NULL, NULL FROM part""")
def bulk_edits(spark, d) -> DataFrame:
    p = table(spark, d, "part").select(F.col(_K).alias("id"), F.when(F.col(_K) % 2 == 0, "measure").otherwise("table").alias("object_type"), F.col("p_brand").alias("display_folder"), F.col("p_type").alias("description"))
    moved = planning.edited(p, "move_folder", value=" Brand#11 ")
    return moved.union(planning.edited(p, "set_property", "description", "  ")).union(planning.edited(p.withColumn("id", F.col("id").cast("string")), "delete").withColumn("id", F.col("id").cast("long")))


@query("""WITH m AS (SELECT p_partkey AS c, CASE p_size % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS risk, p_partkey % 6 AS k FROM part),
  r AS (SELECT c, risk, k, list_filter([CASE WHEN k = 1 THEN 'UNAUTHORIZED_MUTATION' END, CASE WHEN k = 2 THEN 'STRUCTURAL_VALIDATION_FAILURE' END, CASE WHEN k = 3 AND risk IN ('HIGH', 'CRITICAL') THEN 'REQUIRED_RUNTIME_NOT_VERIFIED' END, CASE WHEN k = 4 AND risk <> 'LOW' THEN 'IMPACT_NOT_RUN' END], lambda x: x IS NOT NULL) AS reasons FROM m)
  SELECT c AS change_id, risk, array_to_string(reasons, ',') AS reasons, CASE WHEN k = 1 THEN 'REJECT' WHEN len(reasons) > 0 THEN 'INCONCLUSIVE' WHEN risk IN ('HIGH', 'CRITICAL') AND k <> 5 THEN 'APPROVAL_REQUIRED' ELSE 'ALLOW' END AS decision FROM r""")
def change_gates(spark, d) -> DataFrame:
    """Gates of changes whose risk comes from two mutations, one of them set by an override."""
    p, k = table(spark, d, "part"), F.col(_K) % 6
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_size") % 4 + 1).cast("int"))
    mutations = p.select(F.col(_K).alias("change_id"), F.explode(F.array(
        F.struct(pick(["MEASURE", "MEASURE", "COLUMN", "ROLE"]).alias("object_type"), pick(["description", "expression", "data_type", "members"]).alias("property")),
        F.struct(F.lit("TABLE").alias("object_type"), F.lit("color").alias("property")))).alias("m")).select("change_id", "m.*")
    status = {"security": None, "scope": 1, "baseline": None, "source": None, "static": 2, "runtime": 3, "impact": 4}
    told = [F.struct(F.lit(g).alias("gate"), (F.lit("PASSED") if at is None else F.when(k == at, "FAILED" if at == 1 else "NOT_RUN").otherwise("PASSED")).alias("status")) for g, at in status.items()]
    told.append(F.struct(F.lit("approval").alias("gate"), F.when(k == 5, "PASSED").otherwise("MISSING").alias("status")))
    evidence = p.select(F.col(_K).alias("change_id"), F.explode(F.array(*told)).alias("e")).select("change_id", "e.*")
    return planning.gated(mutations, evidence, {"TABLE:color": "LOW"})
