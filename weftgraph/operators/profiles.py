"""How fields are used on pages, what a visual's status is, which naming rules a model follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import name_style

# Fixed values.
KPI_VISUALS = ["card", "cardvisual", "multirowcard", "kpi", "gauge"]
STATUS_PRIORITY = ["removed", "breaks", "changes", "new", "not_checked", "unchanged"]
NOT_SHOWN = ["sort", "conditional_formatting"]
MIN_OBJECTS, MIN_SUPPORT = 5, 800  #: of a thousand


def usage_profile(uses: DataFrame) -> DataFrame:
    """(object_id, role, visual_type, visuals) from uses (object_id, visual_id, role, visual_type, ...); a use told twice counts once."""
    return uses.groupBy("object_id", "role", "visual_type").agg(F.countDistinct("visual_id").alias("visuals"))


def usage_facts(objects: DataFrame, uses: DataFrame, filters: DataFrame) -> DataFrame:
    """(object_id, fact, n) of ``objects`` (id): what their uses (object_id, visual_id, role, visual_type, page_id, page_type, page_hidden) and filters (object_id, filter_id) tell.

    KPI value, slicer dimension, only in tooltips, only on tooltip pages, only for format or sort, only on hidden pages, only in filters, unused.
    """
    kpi = F.regexp_replace(F.lower("visual_type"), "[^a-z0-9]", "").isin(KPI_VISUALS) & F.col("role").isin("value", "target")
    distinct = lambda when: F.countDistinct(F.when(when, F.col("visual_id")))
    shown = ~F.col("role").isin(NOT_SHOWN)
    told = uses.groupBy("object_id").agg(
        F.countDistinct("visual_id").alias("visuals"), F.countDistinct("page_id").alias("pages"), distinct(kpi).alias("kpi"), distinct(F.col("role") == "slicer_field").alias("slicer"),
        F.count_if(shown).alias("shown"), F.count_if(shown & (F.col("role") != "tooltip")).alias("besides"),
        F.countDistinct(F.when(~F.coalesce(F.col("page_type") == "Tooltip", F.lit(False)), F.col("page_id"))).alias("plain"), F.countDistinct(F.when(~F.coalesce("page_hidden", F.lit(False)), F.col("page_id"))).alias("open"),
    )
    filtered = filters.groupBy("object_id").agg(F.countDistinct("filter_id").alias("filters"))
    both = objects.select(F.col("id").alias("object_id")).join(told, "object_id", "left").join(filtered, "object_id", "left").na.fill(0)
    used, tooltips = F.col("visuals") > 0, (F.col("shown") > 0) & (F.col("besides") == 0)
    one = lambda when, name, n: F.when(when, F.struct(F.lit(name).alias("fact"), F.col(n).alias("n")))
    facts = [
        one(F.col("kpi") > 0, "KPI_VALUE", "kpi"), one(F.col("slicer") > 0, "SLICER_DIMENSION", "slicer"), one(used & tooltips, "ONLY_TOOLTIP", "visuals"),
        one(used & ~tooltips & (F.col("pages") > 0) & (F.col("plain") == 0), "ONLY_TOOLTIP_PAGES", "pages"), one(used & (F.col("shown") == 0), "FORMATTING_OR_SORT_ONLY", "visuals"),
        one(used & (F.col("pages") > 0) & (F.col("open") == 0), "ONLY_HIDDEN_PAGES", "pages"), one(~used & (F.col("filters") > 0), "FILTER_ONLY", "filters"), one(~used & (F.col("filters") == 0), "UNUSED_IN_REPORTS", "filters"),
    ]
    return both.select("object_id", F.explode(F.array_compact(F.array(*facts))).alias("f")).select("object_id", "f.*")


def visual_status(statuses: DataFrame) -> DataFrame:
    """(visual_id, status): of a visual's statuses (visual_id, status) the first by priority; unknown ones alone leave it unchanged."""
    place = F.array_position(F.array(*map(F.lit, STATUS_PRIORITY)), F.col("status"))
    best = F.min(F.when(place > 0, place)).cast("int")
    return statuses.groupBy("visual_id").agg(F.coalesce(F.element_at(F.array(*map(F.lit, STATUS_PRIORITY)), best), F.lit("unchanged")).alias("status"))


def _affixes(name: Column) -> tuple[Column, Column]:
    """The first word with the separator behind it and the last with the one before; null where a name has no separator inside."""
    first, last = F.regexp_extract(name, r"^([^ _]+[ _])", 1), F.regexp_extract(name, r"([ _][^ _]+)$", 1)
    return F.when(first != "", first), F.when(last != "", last)


def naming_rules(names: DataFrame, min_objects: int = MIN_OBJECTS, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(object_type, check, value, obeying, total): per kind of check the rule of ``names`` (object_type, name, folder) with most support.

    Checks are letter case, separators (a name that uses no other obeys), prefix, suffix and folder. A rule needs ``min_objects``
    objects and ``min_support`` of a thousand that obey it; ties go to the smaller value. Counts are per value, so no pair of rule
    and name is formed.
    """
    prefix, suffix = _affixes(F.col("name"))
    spaces, scores = F.col("name").contains(" "), F.col("name").contains("_")
    used = F.when(spaces & scores, "both").when(spaces, "space").when(scores, "underscore").otherwise("none")
    one = lambda check, value: F.when(value.isNotNull(), F.struct(F.lit(check).alias("check"), value.alias("value")))
    told = F.array(one("letter_case", name_style(F.col("name"))), one("separator", used), one("prefix", prefix), one("suffix", suffix), one("folder", F.col("folder")))
    counts = names.select("object_type", F.explode(F.array_compact(told)).alias("c")).groupBy("object_type", "c.check", "c.value").agg(F.count("*").alias("n"))
    totals = names.groupBy("object_type").agg(F.count("*").alias("total")).where(F.col("total") >= min_objects)
    kind = Window.partitionBy("object_type", "check")
    bare = F.sum(F.when((F.col("check") == "separator") & (F.col("value") == "none"), F.col("n")).otherwise(0)).over(kind)
    obeying = F.when((F.col("check") == "separator") & F.col("value").isin("space", "underscore"), F.col("n") + bare).otherwise(F.col("n"))
    offered = counts.withColumn("obeying", obeying).where("NOT (check = 'separator' AND value = 'both') AND NOT (check = 'letter_case' AND value = 'other')").join(totals, "object_type")
    passed = offered.where(F.col("obeying") * 1000 >= F.lit(min_support) * F.col("total"))
    best = passed.groupBy("object_type", "check", "total").agg(F.min(F.struct((-F.col("obeying")).alias("less"), "value")).alias("b"))
    return best.select("object_type", "check", "b.value", (-F.col("b.less")).alias("obeying"), "total")


def breaking_names(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, check, value) of ``names`` (id, object_type, name, folder) and the rules of their type that they do not obey."""
    prefix, suffix = _affixes(F.col("name"))
    both = names.join(F.broadcast(rules.select("object_type", "check", "value")), "object_type")  # a handful of rules per type
    other = F.when(F.col("value") == "space", F.col("name").contains("_")).when(F.col("value") == "underscore", F.col("name").contains(" ")).otherwise(F.col("name").rlike("[ _]"))
    broken = (
        F.when(F.col("check") == "letter_case", name_style(F.col("name")) != F.col("value")).when(F.col("check") == "separator", other)
        .when(F.col("check") == "prefix", ~F.col("name").startswith(F.col("value"))).when(F.col("check") == "suffix", ~F.col("name").endswith(F.col("value")))
        .otherwise(~F.col("folder").eqNullSafe(F.col("value")))
    )
    return both.where(broken).select("id", "check", "value")
