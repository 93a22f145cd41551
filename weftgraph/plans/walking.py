"""A change plan walked over the catalogue graph and a donor, with an alignment between them; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import merge, walks
from weftgraph.plans.queries import query
from weftgraph.sources.catalog import CATALOG_SQL, links, objects
from weftgraph.sources.star import table

# The target lacks every fifth measure and every fourth column. Measures of a key that three divides have no tag, and names that stand many times or
# in the donor alone; all others have a tag and a name of their own.
_SIDES = f"""{CATALOG_SQL},
  m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN 't' || p_partkey END AS tag,
    CASE WHEN p_partkey % 3 <> 0 THEN 'm' || p_partkey ELSE 'n' || (p_partkey % 10) END AS own, CASE WHEN p_partkey % 6 = 3 THEN 'only ' || p_partkey ELSE NULL END AS alone FROM part),
  target AS (SELECT 'measure:' || k AS id, own AS name, tag FROM m WHERE k % 5 <> 0 UNION ALL SELECT 'column:' || s_suppkey, 'c' || s_suppkey, 'c' || s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0
    UNION ALL SELECT id, name, NULL FROM objects WHERE type = 'VISUAL'),
  donor AS (SELECT 'b.measure:' || k AS id, coalesce(alone, own) AS name, tag FROM m UNION ALL SELECT 'b.column:' || s_suppkey, 'C' || s_suppkey, 'c' || s_suppkey FROM supplier),
  needed AS (SELECT 'b.' || from_id AS a, 'b.' || to_id AS b FROM links WHERE type IN ('DEPENDS_ON', 'REFERENCES')),
  used AS (SELECT from_id AS b, to_id AS a, evidence_class = 'FACT' AS fact FROM links WHERE type IN ('DEPENDS_ON', 'USES')),
  aligned AS (SELECT d.id, t.id AS target_id FROM donor d JOIN target t ON t.tag = d.tag),
  adds AS (SELECT 'b.measure:' || k AS k FROM m WHERE k % 20 = 0),
  changes AS (SELECT 'row:' || k AS row_key, 'measure:' || k AS id, CASE k % 60 WHEN 1 THEN 'deleted' WHEN 31 THEN 'deleted' WHEN 7 THEN 'renamed' ELSE 'modified' END AS change,
    CASE WHEN k % 60 = 1 THEN 'cascade' ELSE 'block' END AS policy FROM m WHERE k % 60 IN (1, 31, 7, 13))"""


def _plan(spark, d) -> dict[str, DataFrame]:
    o, e, part, supplier = objects(spark, d), links(spark, d), table(spark, d, "part"), table(spark, d, "supplier")
    k, s, none = F.col("p_partkey"), F.col("s_suppkey"), F.lit(None).cast("string")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    tag, own = F.when(k % 3 != 0, text("t", k)), F.when(k % 3 != 0, text("m", k)).otherwise(text("n", k % 10))

    def side(source: str, measure: str, name: Column, column: str, head: str) -> DataFrame:
        kind = lambda x: F.lit(x).alias("kind")
        measures = part.select(F.lit(source).alias("source"), text(measure, k).alias("id"), kind("MEASURE"), tag.alias("tag"), none.alias("table"), name.alias("name"), k.alias("k"))
        return measures.union(supplier.select(F.lit(source), text(column, s), kind("COLUMN"), text("c", s), none, text(head, s), s.cast("long")))

    lacks = F.when(F.col("kind") == "MEASURE", F.col("k") % 5 == 0).otherwise(F.col("k") % 4 == 0)
    target = side("a", "measure:", own, "column:", "c").where(~lacks)
    donor = side("b", "b.measure:", F.when(k % 6 == 3, text("only ", k)).otherwise(own), "b.column:", "C")
    rows = merge.align_many(target.union(donor), ["a", "b"])
    aligned = rows.where("source = 'b' AND step IS NOT NULL").select("source", "id", F.substring_index("row_key", "a:", -1).alias("target_id"))
    visuals = o.where("type = 'VISUAL'").select("id", "name")
    needed = e.where("type IN ('DEPENDS_ON', 'REFERENCES')").select(F.lit("b").alias("source"), F.concat(F.lit("b."), "from_id").alias("from_id"), F.concat(F.lit("b."), "to_id").alias("to_id"))
    at = k % 60
    changes = part.where(at.isin(1, 31, 7, 13)).select(text("row:", k).alias("row_key"), text("measure:", k).alias("object_id"), F.when(at.isin(1, 31), "deleted").when(at == 7, "renamed").otherwise("modified").alias("change"), F.when(at == 1, "cascade").otherwise("block").alias("policy"))
    return {
        "target": target.select("id", "name").union(visuals), "donor": donor.select("source", "id", "name"), "needed": needed, "aligned": aligned, "changes": changes,
        "adds": part.where(k % 20 == 0).select(text("b.measure:", k).alias("row_key"), F.lit("b").alias("source")),
        "said": part.where(k % 7 == 0).select(text("b.measure:", k).alias("object_id"), F.when(k % 2 == 0, walks.MAPPED).otherwise(walks.DROPPED).alias("action")),
        "used": e.where("type IN ('DEPENDS_ON', 'USES')").select("from_id", "to_id", (F.col("evidence_class") == "FACT").alias("fact")),
        "included": part.where(k % 11 == 0).select(text("row:", k - 4).alias("row_key"), text("measure:", k).alias("object_id")),
        "fields": o.where("type = 'VISUAL'").select(F.lit("sibling").alias("source"), F.concat(F.lit("s."), "id").alias("object_id"), F.concat(F.lit("measure:"), F.substring("id", 8, 20)).alias("field")),
    }


@query(f"""WITH RECURSIVE {_SIDES},
  inner_links AS (SELECT * FROM needed WHERE a IN (SELECT id FROM donor) AND b IN (SELECT id FROM donor)),
  w AS (SELECT k AS origin, k AS id, 0 AS steps FROM adds UNION SELECT w.origin, l.b, 1 FROM w JOIN inner_links l ON l.a = w.id),
  lacking AS (SELECT DISTINCT origin, id FROM w WHERE steps = 1 AND id NOT IN (SELECT id FROM aligned) AND id NOT IN (SELECT id FROM target)),
  said AS (SELECT 'b.measure:' || k AS id, CASE WHEN k % 2 = 0 THEN 'map_to_target' ELSE 'drop_added_object' END AS action FROM m WHERE k % 7 = 0),
  settled AS (SELECT l.origin, l.id, s.action, CASE WHEN s.action = 'map_to_target' THEN 'mapped' WHEN lower(d.name) IN (SELECT lower(name) FROM target) THEN 'name_clash'
    WHEN l.id IN (SELECT k FROM adds) THEN 'will_be_added' ELSE 'missing' END AS severity FROM lacking l JOIN donor d ON d.id = l.id LEFT JOIN said s ON s.id = l.id),
  seeds AS (SELECT c.* FROM changes c WHERE c.id IN (SELECT id FROM target)),
  sure AS (SELECT row_key, id FROM seeds UNION SELECT x.row_key, u.b FROM sure x JOIN used u ON u.a = x.id WHERE u.fact),
  every AS (SELECT row_key, id FROM seeds UNION SELECT x.row_key, u.b FROM every x JOIN used u ON u.a = x.id),
  broken AS (SELECT s.row_key, e.id, s.change, s.policy, (s.row_key, e.id) IN (SELECT row_key, id FROM sure) AS certain FROM seeds s JOIN every e ON e.row_key = s.row_key AND e.id <> s.id)
  SELECT 'needs' AS direction, origin AS cause, 'b' AS source, id AS object_id, severity, 'certain' AS certainty, severity IN ('name_clash', 'missing') AND coalesce(action <> 'drop_added_object', true) AS blocking FROM settled
  UNION ALL SELECT 'breaks', row_key, NULL, id, CASE WHEN NOT certain THEN 'needs_review' WHEN change IN ('deleted', 'renamed') THEN 'breaks' ELSE 'changes_value' END, CASE WHEN certain THEN 'certain' ELSE 'possible' END,
    certain AND ((change = 'deleted' AND policy = 'block') OR (change = 'renamed' AND NOT (row_key, id) IN (SELECT 'row:' || (k - 4), 'measure:' || k FROM m WHERE k % 11 = 0))) FROM broken
  UNION ALL SELECT 'siblings', 'measure:' || substr(id, 8), 'sibling', 's.' || id, 'not_changed_by_this_plan', 'certain', false FROM objects WHERE type = 'VISUAL' AND 'measure:' || substr(id, 8) IN (SELECT id FROM changes WHERE change = 'deleted')""")
def plan_walks(spark, d) -> DataFrame:
    """What a plan breaks, what its added rows need through the alignment, and what siblings use of it."""
    p = _plan(spark, d)
    needs = walks.needs(p["adds"], p["donor"], p["needed"], p["target"], p["aligned"], p["said"])
    breaks = walks.breaks(p["changes"], p["target"], p["used"], p["changes"].select("row_key", "policy"), p["included"])
    return needs.unionByName(breaks).unionByName(walks.siblings(p["changes"], p["fields"])).drop("path")
