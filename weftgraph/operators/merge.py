"""Merging sources: alignment over many, compare rows with marks, carry-over offers, needs, names, rewritten references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expressions import REFERENCE, reference_name, reference_table, tokens
from weftgraph.functions.keys import alnum_key, fold
from weftgraph.functions.lineage import cut
from weftgraph.operators import compare

#: States of a cell, the one that a row shows first. Fixed values.
STATES = ["type_conflict", "missing", "renamed", "moved", "different", "same"]
#: Kinds that hold others; their matches rename the tables of what they hold.
HOLDERS = ["TABLE"]


def _passes(full: bool) -> dict[str, list[Column]]:
    kind, name, table = F.col("kind"), alnum_key(F.col("name")), alnum_key(F.coalesce("table", F.lit("")))
    first = {"tag": [F.col("tag")], "key": [kind, table, name]}
    return first | {"type_conflict": [table, name], "moved": [kind, name]} if full else first


def align_many(objects: DataFrame, order: list[str]) -> DataFrame:
    """(row_key, source, id, step) of the (source, id, kind, tag, table, name) objects of the sources in ``order``.

    The first source is the target: every object of it is a row. A further source matches the target,
    tables before the rest, whose table names then go through the tables' matches; what is left joins
    rows that earlier sources began, by tag or key, or begins a row. ``row_key`` is source and id of the
    object that began the row, whose step is null. A value that stands twice on a side matches nothing.
    Each pass is written once; the number of passes grows with the sources, not with the objects.
    """
    objects = cut(objects.select("source", "id", "kind", "tag", "table", "name").withColumn("row_key", F.concat_ws(":", "source", "id")))
    of = lambda s: objects.where(F.col("source") == s)
    target, is_holder = of(order[0]), F.coalesce(F.col("kind").isin(HOLDERS), F.lit(False))
    begun = None
    placed = [target.select("row_key", "source", "id", F.lit(None).cast("string").alias("step"))]
    for source in order[1:]:
        donor = of(source)
        tables = compare.cascade(target.where(is_holder), donor.where(is_holder), _passes(False))
        names = tables.join(target.select(F.col("id").alias("left_id"), F.col("name").alias("new_table")), "left_id").join(donor.select(F.col("id").alias("right_id"), alnum_key(F.col("name")).alias("t")), "right_id")
        names = names.groupBy("t").agg(F.min("new_table").alias("new_table"))
        moved = cut(donor.withColumn("t", alnum_key(F.col("table"))).join(names, "t", "left").withColumn("table", F.coalesce("new_table", "table")).drop("t", "new_table"))
        rest = compare.cascade(target.where(~is_holder), moved.where(~is_holder), _passes(True))
        found = cut(tables.union(rest).select(F.concat_ws(":", F.lit(order[0]), "left_id").alias("row_key"), F.col("right_id").alias("id"), "step"))
        left = moved.join(found.select("id"), "id", "left_anti")
        if begun is not None:
            joined = compare.cascade(begun.withColumn("id", F.col("row_key")), left, _passes(False)).select(F.col("left_id").alias("row_key"), F.col("right_id").alias("id"), "step")
            found = found.union(joined)
            left = left.join(joined.select("id"), "id", "left_anti")
        left = cut(left)
        begun = left if begun is None else begun.union(left)
        placed += [found.select("row_key", F.lit(source).alias("source"), "id", "step"), left.select("row_key", "source", "id", F.lit(None).cast("string").alias("step"))]
    return reduce(DataFrame.union, placed)


def compare_rows(cells: DataFrame, target: str, sources: int) -> DataFrame:
    """(row_key, row_state, present, donor_conflict) of the (row_key, source, state) cells there are.

    A row shows the first of ``STATES`` among its cells, of which it has ``sources``; those not given are
    missing. Donors conflict where the target has no cell, several donors do, and not all are the same.
    """
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    rows = cells.groupBy("row_key").agg(
        F.min(rank).alias("rank"), F.count("*").alias("present"), F.count_if(F.col("source") == target).alias("own"), F.count_if(F.col("state") != "same").alias("unlike"),
    )
    least = F.least("rank", F.when(F.col("present") < sources, STATES.index("missing") + 1))
    return rows.select("row_key", F.element_at(F.array(*map(F.lit, STATES)), least.cast("int")).alias("row_state"), "present", ((F.col("own") == 0) & (F.col("present") > 1) & (F.col("unlike") > 0)).alias("donor_conflict"))


def marked(placed: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks`` (source, id, mark) with the ``row_key`` they lie on, null for an orphan whose object is gone."""
    return marks.join(placed.select("source", "id", "row_key"), ["source", "id"], "left")


def offers(fields: DataFrame, added: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, kind, name, page, references, missing_fields): donor visuals and pages that use an added object.

    ``fields`` are (source, page, visual, entity, property) uses; ``added`` and ``existing`` hold names,
    as ``entity/property`` or property alone, met without letter case. A visual also tells the fields
    that the target will lack. Lists hold the fields of one visual or the added fields of one page.
    """
    names = added.select(fold(F.col("name")).alias("k"), F.lit(1).alias("new")).union(existing.select(fold(F.col("name")), F.lit(0))).groupBy("k").agg(F.max("new").alias("new"))
    used = fields.select("source", "page", "visual", "entity", "property").distinct()
    each = used.withColumn("k", F.explode(F.array(fold(F.concat_ws("/", "entity", "property")), fold(F.col("property")))))
    told = each.join(names, "k", "left").groupBy(*used.columns).agg(F.coalesce(F.max("new"), F.lit(-1)).alias("new"))
    field = F.concat("entity", F.lit("["), "property", F.lit("]"))
    pick = lambda n: F.array_sort(F.collect_set(F.when(F.col("new") == n, field)))
    visuals = told.groupBy("source", "page", "visual").agg(pick(1).alias("references"), pick(-1).alias("missing_fields")).select("source", F.lit("visual").alias("kind"), F.col("visual").alias("name"), "page", "references", "missing_fields")
    pages = told.groupBy("source", "page").agg(pick(1).alias("references")).select("source", F.lit("page").alias("kind"), F.col("page").alias("name"), F.lit(None).cast("string").alias("page"), "references", F.array().cast("array<string>").alias("missing_fields"))
    return visuals.union(pages).where(F.size("references") > 0)


def settle_needs(needs: DataFrame, kept: DataFrame, deleted: DataFrame, mapped: DataFrame, donors: DataFrame) -> DataFrame:
    """(step, item, outcome, target) for what each ``step`` needs (step, item).

    In this order: ``blocked`` if the plan deletes the item, ``exists``, ``mapped`` to a kept item,
    ``add`` from the donor that has it, ``clash`` if a kept item bears the donor's name, else
    ``missing``. ``kept`` is (item, name), ``mapped`` (item, target), ``donors`` (item, name); each item once.
    """
    flag = lambda df, out: df.select("item", F.lit(True).alias(out)).distinct()
    there = mapped.join(kept.select(F.col("item").alias("target")), "target", "left_semi").select("item", F.col("target").alias("mapped_to"))
    taken = kept.select(fold(F.col("name")).alias("k"), F.lit(True).alias("taken")).dropna().distinct()
    donor = donors.withColumn("k", fold(F.col("name"))).join(taken, "k", "left").select("item", F.lit(True).alias("offered"), "taken")
    every = needs.join(flag(deleted, "gone"), "item", "left").join(flag(kept, "there"), "item", "left").join(there, "item", "left").join(donor, "item", "left")
    outcome = F.when(F.col("gone"), "blocked").when(F.col("there"), "exists").when(F.col("mapped_to").isNotNull(), "mapped").when(F.col("taken"), "clash").when(F.col("offered"), "add").otherwise("missing")
    return every.select("step", "item", outcome.alias("outcome")).join(there, "item", "left").select("step", "item", "outcome", F.when(F.col("outcome") == "mapped", F.col("mapped_to")).when(F.col("outcome").isin("exists", "add"), F.col("item")).alias("target"))


def words(name: Column) -> Column:
    """Words of a name: apart at separators, changes of case, and between letters, digits and other signs."""
    split = F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[^A-Za-z\s])|(?<=[0-9])(?=[^0-9\s])|(?<=[^A-Za-z0-9\s])(?=[A-Za-z0-9])", " ")
    return F.filter(F.split(F.regexp_replace(split, r"[\s_.-]+", " "), " "), lambda w: w != "")


def render(parts: Column, style: str) -> Column:
    """Words as one name in a style: title, pascal, camel, snake, upper or lower."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    if style == "camel":
        return F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(capital(F.lower(w)))), "")
    form = {"title": capital, "pascal": capital, "snake": F.lower, "upper": F.upper, "lower": F.lower}[style]
    return F.array_join(F.transform(parts, form), {"pascal": "", "snake": "_"}.get(style, " "))


def propose_names(objects: DataFrame, taken: DataFrame, space: list[str], style: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """(id, name, proposed, clash) for ``objects`` (id, name and the ``space`` columns) under a naming rule.

    The words are set in the style, with prefix and suffix once. A proposal that ``taken`` (name and
    space) or an earlier id of ``objects`` has, letter case aside, is a clash and gets " (2)" and on.
    Numbers run on from all numbered names taken, so a proposal is never itself taken. A name without a
    word is proposed as it is; a null name has no proposal and no clash.
    """
    whole = F.trim("name")
    bare = F.when(F.lower(whole).startswith(prefix.lower()), F.substring(whole, F.lit(len(prefix) + 1), F.length(whole))).otherwise(whole)
    bare = F.when(F.lower(bare).endswith(suffix.lower()), F.substring(bare, F.lit(1), F.length(bare) - len(suffix))).otherwise(bare)
    parts = words(bare)
    core = F.when(F.size(parts) > 0, F.concat(F.lit(prefix), render(parts, style), F.lit(suffix))).otherwise(F.col("name"))
    number = F.regexp_extract("name", r" \(([0-9]{1,9})\)$", 1)
    used = taken.select(*space, fold(F.regexp_replace("name", r" \([0-9]{1,9}\)$", "")).alias("k"), F.when(number == "", 1).otherwise(number.cast("int")).alias("n")).groupBy(*space, "k").agg(F.max("n").alias("used"))
    at = F.row_number().over(Window.partitionBy(*space, "k").orderBy("id"))
    rows = objects.withColumn("core", core).withColumn("k", fold(F.col("core"))).withColumn("at", at).join(used, [*space, "k"], "left")
    place = F.col("at") + F.coalesce("used", F.lit(0))
    return rows.select("id", "name", F.when(place > 1, F.concat("core", F.lit(" ("), place.cast("string"), F.lit(")"))).otherwise(F.col("core")).alias("proposed"), ((place > 1) & F.col("core").isNotNull()).alias("clash"))


def rewrite(formulas: DataFrame, renames: DataFrame) -> DataFrame:
    """(id, formula, new_formula, changed) of ``formulas`` (id, scope, formula) after ``renames`` (scope, table, name, new_table, new_name).

    A rename with a table and a name meets ``Table[name]``; with a name only, the bare ``[name]``; with a
    table only, every ``Table[...]`` that has no rename of its own. Letter case does not count; strings and
    comments stay as they are; a null new part keeps the old one. ``changed`` counts references rewritten.
    A null scope meets no rename. Only the references are joined, never the texts; a null formula stays null with 0 changed.
    """
    ref = F.explode(F.array_distinct(F.filter(tokens(F.col("formula")), lambda t: t.rlike(f"^(?:{REFERENCE})$"))))
    refs = formulas.select("id", "scope", ref.alias("ref")).select("id", "scope", "ref", fold(reference_table(F.col("ref"))).alias("t"), fold(reference_name(F.col("ref"))).alias("k"))
    own = renames.where("table is not null and name is not null").groupBy("scope", fold(F.col("table")).alias("t"), fold(F.col("name")).alias("k")).agg(F.min(F.struct("new_table", "new_name")).alias("own"))
    bare = renames.where("table is null and name is not null").groupBy("scope", fold(F.col("name")).alias("k")).agg(F.min("new_name").alias("bare_name"))
    owner = renames.where("table is not null and name is null").groupBy("scope", fold(F.col("table")).alias("t")).agg(F.min("new_table").alias("owner_table"))
    told = refs.join(own, ["scope", "t", "k"], "left").join(bare, ["scope", "k"], "left").join(owner, ["scope", "t"], "left")
    return _put_back(formulas, told)


def _put_back(formulas: DataFrame, told: DataFrame) -> DataFrame:
    has_table = F.col("t").isNotNull()
    table = F.when(F.col("own").isNotNull(), F.col("own.new_table")).otherwise(F.col("owner_table"))
    name = F.when(has_table, F.col("own.new_name")).otherwise(F.col("bare_name"))
    raw_table, raw_name = F.regexp_extract("ref", r"^(?s)(.*?)\[", 1), F.regexp_extract("ref", r"(?s)(\[.*)$", 1)
    quoted = F.when(table.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), table).otherwise(F.concat(F.lit("'"), F.replace(table, F.lit("'"), F.lit("''")), F.lit("'")))
    new = F.concat(F.when(has_table & table.isNotNull() & (fold(table) != F.col("t")), quoted).otherwise(raw_table), F.when(name.isNotNull() & (fold(name) != F.col("k")), F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))).otherwise(raw_name))
    hits = told.select("id", "scope", "ref", new.alias("new")).where("ref <> new").groupBy("id", "scope").agg(F.map_from_entries(F.collect_set(F.struct("ref", "new"))).alias("m"))
    both = formulas.join(hits, ["id", "scope"], "left")
    parts = tokens(F.col("formula"))
    text = F.array_join(F.transform(parts, lambda t: F.coalesce(F.element_at("m", t), t)), "")
    count = F.size(F.filter(parts, lambda t: F.map_contains_key("m", t)))
    changed = F.col("m").isNotNull()
    return both.select("id", "formula", F.when(changed, text).otherwise(F.col("formula")).alias("new_formula"), F.when(changed, count).otherwise(0).alias("changed"))
