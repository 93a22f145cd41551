"""One object, or a selection of objects, looked at: what it holds, what it is linked with, what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.validation import reference_rules, smallest

MOST_LISTED = 300


def contents(objects: DataFrame, links: DataFrame, of: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """(id, kind, child, name, children, n) of what the containers ``of`` (id) hold: the first ``most`` of each kind by name, with
    their own numbers of children; ``n`` counts all of the kind. The listing is bounded as a page is; the counts are not.
    """
    held = links.where("type = 'CONTAINS'").select(F.col("from_id").alias("id"), F.col("to_id").alias("child"))
    below = held.groupBy(F.col("id").alias("child")).agg(F.count("*").alias("children"))
    own = held.join(of.select("id").distinct(), "id", "left_semi").join(objects.select(F.col("id").alias("child"), F.col("type").alias("kind"), "name"), "child")
    counts = own.groupBy("id", "kind").agg(F.count("*").alias("n"))
    order = [F.lower("name"), F.col("child")]
    parts = own.withColumn("part", F.pmod(F.xxhash64("child"), F.lit(32)))
    some = parts.withColumn("k", F.row_number().over(Window.partitionBy("id", "kind", "part").orderBy(*order))).where(F.col("k") <= most)
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("id", "kind").orderBy(*order))).where(F.col("k") <= most)
    return first.join(below, "child", "left").join(counts, ["id", "kind"]).select("id", "kind", "child", "name", F.coalesce("children", F.lit(0)).alias("children"), "n")


def neighbourhood(objects: DataFrame, links: DataFrame, of: DataFrame, most: int = 3) -> DataFrame:
    """(id, direction, type, kind, n, first): per object, link type and kind of neighbour how many there are, and the ``most`` smallest ids."""
    wanted = of.select("id").distinct()
    side = lambda own, other, way: links.select(F.col(own).alias("id"), F.lit(way).alias("direction"), "type", F.col(other).alias("other")).join(wanted, "id", "left_semi")
    both = side("from_id", "to_id", "out").union(side("to_id", "from_id", "in")).distinct()
    told = both.join(objects.select(F.col("id").alias("other"), F.col("type").alias("kind")), "other")
    key = F.to_json(F.struct("id", "direction", "type", "kind"))
    counted = told.groupBy("id", "direction", "type", "kind").agg(F.count("*").alias("n")).withColumn("key", key)
    few = smallest(told.select(key.alias("key"), "other"), "key", "other", most)
    return counted.join(few, "key").select("id", "direction", "type", "kind", "n", F.col("items").alias("first"))


def selection(objects: DataFrame, links: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code, severity, object_id, edge_id, detail) of what is wrong with the objects ``wanted`` (id) alone, sorted by severity and code.

    Ids that are no object, and broken references of those objects or of links at them; issues elsewhere do not count.
    """
    ids = wanted.select("id").distinct()
    none = F.lit(None).cast("string")
    missing = ids.join(objects.select("id"), "id", "left_anti").select(F.lit("missing_object").alias("code"), F.lit("ERROR").alias("severity"), F.col("id").alias("object_id"), none.alias("edge_id"), none.alias("detail"))
    near = links.select("id", F.explode(F.array("from_id", "to_id")).alias("end")).join(ids.select(F.col("id").alias("end")), "end", "left_semi").select(F.col("id").alias("edge_id")).distinct()
    found = reference_rules(objects, links)
    own = found.where("object_id IS NOT NULL").join(ids.select(F.col("id").alias("object_id")), "object_id", "left_semi")
    at = found.where("edge_id IS NOT NULL").join(near, "edge_id", "left_semi")
    return missing.unionByName(own).unionByName(at).distinct().orderBy("severity", "code", "object_id", "edge_id")


def state_of(issues: DataFrame) -> DataFrame:
    """(state): invalid with an error, warning with a warning, else valid."""
    return issues.agg(F.when(F.count_if(F.col("severity").isin("ERROR", "BLOCKING")) > 0, "invalid").when(F.count_if(F.col("severity") == "WARNING") > 0, "warning").otherwise("valid").alias("state"))


def co_occurrence(rows: DataFrame, group: str, item: str, least: int = 2, most: int = 10) -> DataFrame:
    """(a, b, together, examples): pairs of items that share ``least`` groups or more, with the smallest ``most`` of them.

    Groups are what a person laid out together, a page or an order. Pairs are what is asked for, so their number is that of
    the answer before ``least`` cuts it.
    """
    own = rows.select(group, item).distinct()
    pairs = own.select(group, F.col(item).alias("a")).join(own.select(group, F.col(item).alias("b")), group).where("a < b")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    key = F.to_json(F.struct("a", "b"))
    kept = pairs.join(counts.select("a", "b"), ["a", "b"], "left_semi")
    few = smallest(kept.select(key.alias("key"), group), "key", group, most)
    return counts.withColumn("key", key).join(few, "key").select("a", "b", "together", F.col("items").alias("examples"))


def cross_tab(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """(by, one column per value, total), zero filled, and a last row of totals with a null ``by``; one pass by grouping sets."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return rows.rollup(by).agg(*counts, F.count_if(F.col(column).isin(values)).alias("total"), F.grouping(by).alias("all")).select(by, *values, "total", "all")
