"""Changes, alignment, commonality and result comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import fingerprint
from weftgraph.functions.lineage import cut
from weftgraph.functions.numbers import moved_by, within


def classify(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, status, old_hash, new_hash): NEW, DELETED, CHANGED or UNCHANGED by fingerprint."""
    a = old.select(key, fingerprint(*map(F.col, values)).alias("old_hash"))
    b = new.select(key, fingerprint(*map(F.col, values)).alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "NEW").when(F.col("new_hash").isNull(), "DELETED").when(F.col("old_hash") == F.col("new_hash"), "UNCHANGED").otherwise("CHANGED")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), "old_hash", "new_hash")


def with_renames(old: DataFrame, new: DataFrame, key: str, name: str, values: list[str]) -> DataFrame:
    """(key, status): as ``classify``, but a changed name alone is RENAMED."""
    a = old.select(key, F.col(name).alias("old_name"), fingerprint(*map(F.col, values)).alias("a"))
    b = new.select(key, F.col(name).alias("new_name"), fingerprint(*map(F.col, values)).alias("b"))
    status = F.when(F.col("a").isNull(), "CREATED").when(F.col("b").isNull(), "DELETED").when(F.col("old_name") != F.col("new_name"), "RENAMED").when(F.col("a") != F.col("b"), "CHANGED").otherwise("SAME")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def unique_match(left: DataFrame, right: DataFrame, key: list[Column], id_col: str = "id") -> DataFrame:
    """(left_id, right_id) where the key is there once on either side."""
    names = [f"k{i}" for i in range(len(key))]
    once = lambda df, out: df.select(F.col(id_col).alias(out), *[k.alias(n) for k, n in zip(key, names, strict=True)]).dropna(subset=names).groupBy(*names).agg(F.min(out).alias(out), F.count("*").alias("n")).where("n = 1").drop("n")
    return once(left, "left_id").join(once(right, "right_id"), names).select("left_id", "right_id")


def cascade(left: DataFrame, right: DataFrame, passes: dict[str, list[Column]], id_col: str = "id", forbidden: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, step): passes in order, matched rows leave both pools.

    Matches of a pass are written before the next, which would else compute every earlier pass twice.
    """
    found = None
    for step, key in passes.items():
        pairs = unique_match(left, right, key, id_col)
        if forbidden is not None:
            pairs = pairs.join(forbidden, ["left_id", "right_id"], "left_anti")
        got = cut(pairs.withColumn("step", F.lit(step)))
        left = left.join(got.select(F.col("left_id").alias(id_col)), id_col, "left_anti")
        right = right.join(got.select(F.col("right_id").alias(id_col)), id_col, "left_anti")
        found = got if found is None else found.union(got)
    return found


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with how often they stand in ``a`` more than in ``b``; none if the bags are equal."""
    columns = a.columns
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")


def compare_results(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], mode: str, absolute: float = 0.0, relative: float = 0.0, least: float = 0.0, most: float = 0.0) -> DataFrame:
    """Per key the verdict of one regression mode: passed is true, false, or null where a row is missing."""
    a = before.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    b = after.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    one = {
        "EXACT": lambda x, y, kind: x.eqNullSafe(y),
        "NUMERIC_TOLERANCE": lambda x, y, kind: within(x, y, kind, absolute, relative),
        "EXPECTED_DELTA": lambda x, y, kind: moved_by(x, y, kind, least, most),
    }[mode]
    passed = reduce(lambda p, q: p & q, [one(F.col(f"a_{v}"), F.col(f"b_{v}"), before.schema[v].dataType) for v in values])
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("in_a") & F.col("in_b"), passed).alias("passed"))


def commonality(objects: DataFrame) -> DataFrame:
    """Buckets of (kind, name_key, signature, source) objects.

    A name in one source is ``unique``, unless another name shares its signature in another
    source, each once per source: then both are ``renamed``. In several sources it is
    ``identical`` with one signature, else ``differs``.
    """
    rows = objects.groupBy("kind", "name_key").agg(F.countDistinct("source").alias("sources"), F.countDistinct("signature").alias("variants"), F.min("signature").alias("signature"))
    alone = rows.where("sources = 1 and variants = 1").join(objects.select("kind", "name_key", "source").distinct(), ["kind", "name_key"])
    moved = alone.groupBy("kind", "signature").agg(F.count("*").alias("names"), F.countDistinct("source").alias("apart")).where("names > 1 and names = apart").select("kind", "signature", F.lit(True).alias("moved"))
    bucket = F.when((F.col("sources") == 1) & F.col("moved"), "renamed").when(F.col("sources") == 1, "unique").when(F.col("variants") == 1, "identical").otherwise("differs")
    return rows.join(moved, ["kind", "signature"], "left").select("kind", "name_key", "sources", "variants", bucket.alias("bucket"))
