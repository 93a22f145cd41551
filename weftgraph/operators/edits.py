"""Plans of changes: previews of bulk edits, their risk, name clashes, donors that disagree, order of steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import fold

#: Risk levels from low to high, and what raises a change to them. Fixed values.
LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
COSMETIC = ["description", "display_folder"]
STRUCTURAL_KINDS = ["RELATIONSHIP", "CALCULATION_GROUP", "CALCULATION_ITEM", "COLUMN", "TABLE"]
SECURITY_KINDS = ["ROLE", "TABLE_PERMISSION", "OBJECT_LEVEL_SECURITY", "ROW_LEVEL_SECURITY"]
CRITICAL_WORDS = ["roles", "permission", "partition", "source", "storage", "security"]


def risk(kind: Column, prop: Column) -> Column:
    """Risk level of changing a property of an object of a kind."""
    critical = kind.isin(SECURITY_KINDS) | reduce(lambda a, b: a | b, [F.lower(prop).contains(w) for w in CRITICAL_WORDS])
    return F.when(critical, "CRITICAL").when(prop.isin(COSMETIC), "LOW").when(kind.isin(STRUCTURAL_KINDS), "HIGH").otherwise("MEDIUM")


def highest(level: Column) -> Column:
    """Aggregate: the highest of the levels; null for none."""
    return F.max_by(level, F.array_position(F.array(*map(F.lit, LEVELS)), level))


def rename_preview(objects: DataFrame, pattern: str, by: str, space: list[str]) -> DataFrame:
    """(id, name, new_name, clash) of objects whose ``name`` a pattern changes.

    A clash is a folded new name that another object of the same ``space`` columns has after all
    renames. Names are counted per space and name, so no pair of objects is formed.
    """
    after = objects.withColumn("new_name", F.regexp_replace("name", pattern, by))
    taken = after.groupBy(*space, fold(F.col("new_name")).alias("k")).agg(F.count("*").alias("n"))
    moved = after.where("new_name <> name").withColumn("k", fold(F.col("new_name")))
    return moved.join(taken, [*space, "k"]).select("id", "name", "new_name", (F.col("n") > 1).alias("clash"))


def disagreeing(donors: DataFrame, key: str, value: str) -> DataFrame:
    """(key, variants) of objects for which the donors bring more than one value; a null is a value."""
    return donors.groupBy(key).agg(F.countDistinct(F.coalesce(F.concat(F.lit("="), F.col(value).cast("string")), F.lit("~"))).alias("variants")).where("variants > 1")


def outcome(removed: DataFrame, uses: DataFrame, policy: Column) -> DataFrame:
    """(item, dependents, result) of removals under a policy column: block stops where something depends on the item."""
    users = uses.groupBy("item").agg(F.countDistinct("owner").alias("dependents"))
    told = removed.join(users, "item", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    return told.select("item", "dependents", F.when(F.col("dependents") == 0, "remove").when(policy == "block", "blocked").when(policy == "cascade", "remove_all").otherwise("repoint").alias("result"))


def step_order(steps: DataFrame, phases: list[str]) -> DataFrame:
    """``steps`` (phase, layer, id) in the order they are done: by phase, inside by layer and id; deletions from the last layer back."""
    place = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    return steps.orderBy(place, F.when(F.col("phase") == "delete", -F.col("layer")).otherwise(F.col("layer")), "id")
