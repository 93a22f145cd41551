"""Alignment of objects over sources, states of their cells, deep property differences, regression verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import alnum_key
from weftgraph.functions.lineage import counted, cut
from weftgraph.operators import compare


def alignment_key(kind: Column, table: Column, name: Column, ends: Column) -> Column:
    """What objects of two sources share: relationships their ends in either order, others kind, table and name."""
    pair = F.concat_ws("~", F.array_sort(F.transform(ends, alnum_key)))
    return F.when(kind == "RELATIONSHIP", F.concat(F.lit("RELATIONSHIP|"), pair)).otherwise(F.concat_ws("|", kind, alnum_key(F.coalesce(table, F.lit(""))), alnum_key(name)))


def align(target: DataFrame, source: DataFrame, manual: DataFrame | None = None, forbidden: DataFrame | None = None, second: str | None = None) -> DataFrame:
    """(left_id, right_id, step) between (id, kind, tag, table, name, signature) rows of two sources.

    Passes: pairs a person confirmed (``manual``: left_id, right_id), lineage tag, key, the column ``second`` as another key if one is
    named, table and name in another kind, name in kind (moved), signature (renamed). A value that stands twice on a side
    matches nothing in its pass; nulls never match. A pair in ``forbidden`` (left_id, right_id) is not made, and both stay.
    """
    kind, name, table = F.col("kind"), alnum_key(F.col("name")), alnum_key(F.coalesce("table", F.lit("")))
    passes = {"tag": [F.col("tag")], "key": [kind, table, name]} | ({"second_key": [kind, F.col(second)]} if second else {})
    passes |= {"type_conflict": [table, name], "moved": [kind, name], "possible_rename": [kind, F.col("signature")]}
    if manual is None:
        return compare.cascade(target, source, passes, forbidden=forbidden)
    once = manual.join(target.select(F.col("id").alias("left_id")), "left_id", "left_semi").join(source.select(F.col("id").alias("right_id")), "right_id", "left_semi")
    if forbidden is not None:
        once = once.join(forbidden, ["left_id", "right_id"], "left_anti")
    # of two confirmed pairs that share an end neither can be told to be meant
    single = lambda c: once.groupBy(c).count().where("count = 1").select(c)
    given = cut(once.join(single("left_id"), "left_id", "left_semi").join(single("right_id"), "right_id", "left_semi").select("left_id", "right_id", F.lit("manual").alias("step")))
    left = target.join(given.select(F.col("left_id").alias("id")), "id", "left_anti")
    right = source.join(given.select(F.col("right_id").alias("id")), "id", "left_anti")
    return given.union(compare.cascade(left, right, passes, forbidden=forbidden))


def duplicate_tags(source: DataFrame) -> DataFrame:
    """(tag, objects, first): lineage tags that several objects of a source bear, which is why no pass uses them."""
    return source.where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("objects"), F.min("id").alias("first")).where("objects > 1")


def cell_states(target: DataFrame, source: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, state) for every target object against one source; the first that holds of type_conflict, missing, renamed, moved, different, same."""
    t = target.select(F.col("id").alias("left_id"), *[F.col(c).alias(f"t_{c}") for c in ("kind", "table", "name", "signature")])
    s = source.select(F.col("id").alias("right_id"), *[F.col(c).alias(f"s_{c}") for c in ("kind", "table", "name", "signature")])
    both = t.join(matches.select("left_id", "right_id"), "left_id", "left").join(s, "right_id", "left")
    differs = lambda c: ~F.col(f"t_{c}").eqNullSafe(F.col(f"s_{c}"))
    state = F.when(F.col("right_id").isNull(), "missing").when(differs("kind"), "type_conflict").when(differs("name"), "renamed").when(differs("table"), "moved").when(differs("signature"), "different").otherwise("same")
    return both.select(F.col("left_id").alias("id"), state.alias("state"))


def _pointer(path: str, name: str) -> Column:
    """The path one key further down; ``~`` and ``/`` of keys are written ``~0`` and ``~1``."""
    own = F.replace(F.replace(F.col(name), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.when(F.col(path) == "", own).otherwise(F.concat_ws("/", path, own))


def _opened(value: str) -> Column:
    return F.try_variant_get(F.col(value), "$", "map<string,variant>")


def _told(value: str) -> tuple[Column, Column]:
    """The JSON text of a value, and whether it has a fraction in its form: 1 and 1.0 differ, 1.0 and 1.00 do not."""
    kind = F.schema_of_variant(F.col(value))
    return F.to_json(F.col(value)), kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")


def leaves(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value) of the leaves of JSON objects, as deep as they go, values as JSON; arrays and empty objects are leaves.

    Values are variants, so that types stay. A round opens one level of all objects that still have one, so there are as many
    rounds as levels. What is no JSON object has no leaves.
    """
    level = cut(rows.select(key, F.lit("").alias("path"), F.try_parse_json(json).alias("value")))
    done, first, more = [], True, 1
    while more:
        told = level.withColumn("inner", _opened("value"))
        inside = F.coalesce(F.size("inner"), F.lit(0)) > 0
        if not first:
            done.append(told.where(~inside).select(key, "path", F.to_json("value").alias("value")))
        below = told.where(inside).select(key, "path", F.explode("inner").alias("name", "value"))
        level, more = counted(below.select(key, _pointer("path", "name").alias("path"), "value"))
        first = False
    return reduce(DataFrame.union, done) if done else level.select(key, "path", F.to_json("value").alias("value"))


def deep_diff(old: DataFrame, new: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, change, old_value, new_value) of JSON properties that were added, removed or changed; values as JSON, null where there is none.

    Both sides are walked together. Objects are opened on either side or, if the other has nothing there, on one; anything else
    is compared as a whole, so an object that became a text, or 1 that became "1", is one change. Arrays are values.
    A side that is null or no JSON object has no properties.
    """
    side = lambda df, out: df.select(key, F.try_parse_json(json).alias(out)).where(_opened(out).isNotNull())
    level, more, first, done = *counted(side(old, "x").join(side(new, "y"), key, "full_outer").select(key, F.lit("").alias("path"), "x", "y")), True, []
    while more:
        told = level.withColumns({"a": _opened("x"), "b": _opened("y")})
        (p, fine_p), (q, fine_q) = _told("x"), _told("y")
        no_x, no_y, a, b = F.col("x").isNull(), F.col("y").isNull(), F.col("a"), F.col("b")
        apart = ~p.eqNullSafe(q) | ~fine_p.eqNullSafe(fine_q)
        opened = (a.isNotNull() | no_x) & (b.isNotNull() | no_y) & (F.coalesce(F.size("a"), F.lit(0)) + F.coalesce(F.size("b"), F.lit(0)) > 0)
        if not first:
            done.append(told.where(~opened & apart).select(key, "path", F.when(no_x, "added").when(no_y, "removed").otherwise("changed").alias("change"), p.alias("old_value"), q.alias("new_value")))
        differ = ~p.eqNullSafe(q) | ~F.schema_of_variant("x").eqNullSafe(F.schema_of_variant("y"))
        keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
        below = told.where(opened & differ).select(key, "path", "a", "b", F.explode(F.array_union(keys("a"), keys("b"))).alias("name"))
        level, more = counted(below.select(key, _pointer("path", "name").alias("path"), F.try_element_at("a", F.col("name")).alias("x"), F.try_element_at("b", F.col("name")).alias("y")))
        first = False
    return reduce(DataFrame.union, done) if done else level.select(key, "path", F.lit("changed").alias("change"), F.to_json("x").alias("old_value"), F.to_json("y").alias("new_value"))


def verdict(before: DataFrame, after: DataFrame, mode: str, keys: list[str], values: list[str], missing: bool = False, new: bool = False, expected: DataFrame | None = None, how: str = "EXACT", **limits: float) -> DataFrame:
    """One row (mode, passed, compared, failed, missing_rows, new_rows) for a whole result whose rows have ``keys``.

    ``regression`` compares by place instead. SCHEMA_ONLY compares names, types and the number of rows; SET_EQUIVALENCE bags of rows; PRESERVE_AGGREGATE asks for one
    row a side and the tolerance; MONITOR is never passed or failed. Rows that one side lacks fail
    unless allowed, and in SET_EQUIVALENCE always. Names or types that differ fail every mode but MONITOR. EXPECTED_VALUE and
    EXPECTED_CHANGE hold ``after`` against ``expected`` by mode ``how``, and against ``before`` by the
    number of rows alone; without ``expected`` they fail.
    """
    if mode in ("EXPECTED_VALUE", "EXPECTED_CHANGE"):
        if how not in ("EXACT", "NUMERIC_TOLERANCE", "SET_EQUIVALENCE"):
            raise ValueError(f"an expected result is not compared by {how}")
        told = verdict(before if expected is None else expected, after, how, keys, values, **limits)
        grown, alike = after.count() - before.count(), before.schema.simpleString() == after.schema.simpleString()
        passed = expected is not None and alike and (missing or grown >= 0) and (new or grown <= 0)
        return told.withColumn("mode", F.lit(mode)).withColumn("passed", F.col("passed") & F.lit(passed))
    spark, head = before.sparkSession, "mode string, passed boolean, compared long, failed long, missing_rows long, new_rows long"
    same = [(f.name, f.dataType) for f in before.schema] == [(f.name, f.dataType) for f in after.schema]
    if mode == "SCHEMA_ONLY" and same:
        lost = before.count() - after.count()
        passed = (missing or lost <= 0) and (new or lost >= 0)
        return spark.createDataFrame([(mode, passed, 0, 0, max(lost, 0), max(-lost, 0))], head)
    if mode == "MONITOR" or not same:
        return spark.createDataFrame([(mode, None if mode == "MONITOR" else same, 0, 0, 0, 0)], head)
    if mode == "SET_EQUIVALENCE":
        counts = compare.bag_difference(before, after).agg(F.coalesce(F.sum(F.greatest("surplus", F.lit(0))), F.lit(0)).alias("missing_rows"), F.coalesce(F.sum(-F.least("surplus", F.lit(0))), F.lit(0)).alias("new_rows"))
        passed = (F.col("missing_rows") == 0) & (F.col("new_rows") == 0)
        return counts.select(F.lit(mode).alias("mode"), passed.alias("passed"), F.lit(0).cast("long").alias("compared"), F.lit(0).cast("long").alias("failed"), "missing_rows", "new_rows")
    how = "NUMERIC_TOLERANCE" if mode == "PRESERVE_AGGREGATE" else mode
    rows = compare.compare_results(before, after, keys, values, how, **limits).join(before.select(*keys, F.lit(True).alias("__before")), keys, "left")
    counts = rows.agg(F.count("passed").alias("compared"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull() & F.col("__before").isNotNull()).alias("missing_rows"), F.count_if(F.col("passed").isNull() & F.col("__before").isNull()).alias("new_rows"))
    passed = (F.col("failed") == 0) & (F.lit(missing) | (F.col("missing_rows") == 0)) & (F.lit(new) | (F.col("new_rows") == 0))
    if mode == "PRESERVE_AGGREGATE":
        passed = passed & (F.col("compared") == 1)
    return counts.select(F.lit(mode).alias("mode"), passed.alias("passed"), "compared", "failed", "missing_rows", "new_rows")


def roll_up(verdicts: DataFrame) -> DataFrame:
    """One row: verdicts passed, failed and inconclusive, and their sum as a status."""
    counts = verdicts.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("inconclusive"))
    return counts.withColumn("status", F.when(F.col("failed") > 0, "FAILED").when(F.col("inconclusive") > 0, "INCONCLUSIVE").otherwise("PASSED"))
