"""Impact closure by rules, context slices, upstream sources, removal preview, breaks and needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import Rounds, cut
from weftgraph.operators.traversal import rounds

#: From certain to unknown; a path is as uncertain as its weakest step. Fixed values.
CATEGORIES = ["DIRECT", "STRUCTURAL", "CONDITIONAL", "POTENTIAL_BEHAVIORAL", "UNKNOWN"]


@dataclass(frozen=True)
class Rule:
    """Edges of ``types``, followed with (``out``) or against their direction."""

    name: str
    types: tuple[str, ...]
    out: bool = False
    category: str = "STRUCTURAL"


def steps(edges: DataFrame, rules: list[Rule], fact: Column | None = None) -> DataFrame:
    """(at, id, rule, rank, fact): every edge once per rule that follows it, in one scan."""
    sure = F.lit(True) if fact is None else F.coalesce(fact, F.lit(False))
    one = lambda r: F.when(
        F.col("type").isin(*r.types),
        F.struct(F.col("from_id" if r.out else "to_id").alias("at"), F.col("to_id" if r.out else "from_id").alias("id"), F.lit(r.name).alias("rule"), F.lit(CATEGORIES.index(r.category)).alias("rank"), sure.alias("fact")),
    )
    return edges.select(F.explode(F.array_compact(F.array(*map(one, rules)))).alias("s")).select("s.*").where("at is not null and id is not null")


def closure(links: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(id, depth, rule, category, certainty, path) of all that ``seeds`` (id) reach, in ``most`` rounds or at all.

    An object keeps one shortest record: of equally short ones the smallest predecessor, then rule.
    A record is INFERRED if its path has a step that is not a fact or a category past STRUCTURAL.
    Null seeds and ends reach nothing; a seed that no edge names is its own only record.
    """
    links = cut(links)
    found = Rounds(seeds.dropna().distinct().select("id", F.lit(0).alias("depth"), F.lit("seed").alias("rule"), F.lit(0).alias("rank"), F.lit(True).alias("fact"), F.array("id").alias("path")))
    frontier = found.all()
    for at in rounds(most):
        told = frontier.select(F.col("id").alias("at"), F.col("rank").alias("old_rank"), F.col("fact").alias("old_fact"), "path")
        step = told.join(links, "at").join(found.all().select("id"), "id", "left_anti")
        best = F.min(F.struct("at", "rule", "fact", F.greatest("rank", "old_rank").alias("rank"), "old_fact", "path")).alias("b")
        frontier = found.add(
            step.groupBy("id").agg(best)
            .select("id", F.lit(at).alias("depth"), "b.rule", "b.rank", (F.col("b.fact") & F.col("b.old_fact")).alias("fact"), F.concat("b.path", F.array("id")).alias("path"))
        )
        if not found.added:
            break
    state = found.all()
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("rank") + 1)
    return state.select("id", "depth", "rule", category.alias("category"), F.when(F.col("fact") & (F.col("rank") < 2), "FACT").otherwise("INFERRED").alias("certainty"), "path")


def context_slice(edges: DataFrame, seeds: DataFrame, moves: list[tuple[str, tuple[str, ...], bool, str]], most: int | None = None) -> DataFrame:
    """(id, mode): a walk whose next steps depend on how an object was reached.

    A move is (mode, edge types, along the edge, next mode); seeds have mode ``target``. Modes that no
    move starts from are listed, not walked. So parents stay and siblings do not.
    """
    one = lambda m: F.when(
        F.col("type").isin(*m[1]),
        F.struct(F.lit(m[0]).alias("mode"), F.col("from_id" if m[2] else "to_id").alias("id"), F.lit(m[3]).alias("next_mode"), F.col("to_id" if m[2] else "from_id").alias("next_id")),
    )
    links = edges.select(F.explode(F.array_compact(F.array(*map(one, moves)))).alias("s")).select("s.*")
    links, found = cut(links), Rounds(seeds.distinct().select("id", F.lit("target").alias("mode")))
    frontier = found.all()
    for _ in rounds(most):
        new = frontier.join(links, ["id", "mode"]).select(F.col("next_id").alias("id"), F.col("next_mode").alias("mode")).distinct()
        frontier = found.add(new.join(found.all(), ["id", "mode"], "left_anti"))
        if not found.added:
            break
    return found.all()


def upstream(edges: DataFrame, origins: DataFrame, goals: DataFrame, most: int | None = None) -> DataFrame:
    """(origin, source, depth, via): per origin the first of ``goals`` (id) on each way along the edges.

    The walk ends at a goal; of equally short ways the one over the smallest last step is told. It runs from the goals
    back, so its state is a row per object and goal that it leads to, not per origin and object on the way, and
    ``most`` bounds its rounds. Rounds find and keep only what other objects lead to; a last step, whose result is not
    written, takes every origin over its own edges. To it goals go as lists of short numbers behind a common text.
    """
    marked = goals.select("id").distinct()
    flagged = marked.select(F.col("id").alias("from_id"), F.lit(True).alias("is_goal"))
    links = cut(edges.select("from_id", F.col("to_id").alias("id")))
    heads = cut(links.select(F.col("id").alias("from_id")).dropna().distinct().join(flagged, "from_id", "left").select("from_id", F.coalesce("is_goal", F.lit(False)).alias("is_goal")))
    inner = cut(links.join(heads, "from_id"))
    found = Rounds(marked.select("id", F.col("id").alias("source"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(False).alias("is_goal")))
    frontier = found.all()
    for at in rounds(None if most is None else most - 1):
        step = frontier.where("NOT is_goal").select("id", "source", "via").join(inner.select("id", "from_id", F.col("is_goal").alias("ends")), "id")
        best = step.groupBy(F.col("from_id").alias("id"), "source").agg(F.min(F.coalesce("via", "from_id")).alias("via"), F.first("ends").alias("is_goal"))
        frontier = found.add(best.join(found.all().select("id", "source"), ["id", "source"], "left_anti").select("id", "source", F.lit(at).alias("depth"), "via", "is_goal"))
        if not found.added:
            break
    # a goal's id is a text and the number it ends with; lists hold the low 15 bits of those that have the others in common
    number = F.regexp_extract("source", r"(?s)^.*?(0|[1-9]\d{0,8})$", 1)
    told = found.all().where("NOT is_goal").withColumn("number", F.when(number != "", number.cast("int")).otherwise(-1))
    told = told.withColumn("text", F.when(F.col("number") >= 0, F.substring("source", F.lit(1), F.length("source") - F.length(F.col("number").cast("string")))).otherwise(F.col("source")))
    low, high = F.col("number").bitwiseAND(0x7FFF).cast("smallint"), F.shiftright("number", 15)
    lists = told.groupBy("id", "depth", "via", "text", high.alias("high")).agg(F.sort_array(F.collect_list(low)).alias("lows"))
    sent = links.join(lists, "id").select(F.col("from_id").alias("origin"), (F.col("depth") + 1).alias("depth"), F.coalesce("via", "from_id").alias("via"), "text", "high", "lows")
    if most is not None:
        sent = sent.where(F.col("depth") <= most)
    each = sent.repartition("origin").select("origin", "depth", "via", "text", "high", F.explode("lows").alias("low"))
    best = each.groupBy("origin", "text", "high", "low").agg(F.min(F.struct("depth", "via")).alias("b"))
    source = F.when(F.col("high") < 0, F.col("text")).otherwise(F.concat("text", F.shiftleft("high", 15).bitwiseOR(F.col("low").cast("int")).cast("string")))
    asked = origins.select(F.col("id").alias("origin")).dropna().distinct()
    return best.join(asked, "origin", "left_semi").select("origin", source.alias("source"), "b.depth", "b.via").where("origin <> source")


def removal_preview(uses: DataFrame, removed: DataFrame) -> DataFrame:
    """(owner, used, lost, action) for owners that use a removed item: without any other item the owner goes too."""
    flags = uses.select("owner", "item").distinct().join(removed.select("item", F.lit(True).alias("gone")).distinct(), "item", "left")
    counts = flags.groupBy("owner").agg(F.count("*").alias("used"), F.count("gone").alias("lost"))
    return counts.where("lost > 0").withColumn("action", F.when(F.col("used") == F.col("lost"), "remove_owner").otherwise("remove_field"))


def repoint(items: DataFrame, removed: DataFrame, kind: str, shape: str) -> DataFrame:
    """(item, candidates, best, type_warning): kept items of the kind of a removed one, told by its smallest id.

    Kept items are counted per kind before the join, so no pair of items is formed. The warning is
    set where no kept item of the kind has the removed one's ``shape``.
    """
    kept = items.join(removed, "item", "left_anti")
    by_kind = kept.groupBy(kind).agg(F.count("*").alias("candidates"), F.min("item").alias("any_item"))
    by_shape = kept.groupBy(kind, shape).agg(F.min("item").alias("same_item"))
    gone = items.join(removed, "item", "left_semi")
    told = gone.join(by_kind, kind, "left").join(by_shape, [kind, shape], "left")
    return told.select("item", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("same_item", "any_item").alias("best"), (F.col("same_item").isNull() & F.col("any_item").isNotNull()).alias("type_warning"))


def breaks(edges_after: DataFrame, deleted: DataFrame, survivors: DataFrame) -> DataFrame:
    """(id, user): edges of surviving objects that still lead to a deleted one."""
    hit = edges_after.join(deleted.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return hit.join(survivors.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id"), F.col("from_id").alias("user")).distinct()


def needs(expressions: DataFrame, text: Column, pattern: str, known: DataFrame) -> DataFrame:
    """(name, users): names in expressions (id) that ``known`` (name) lacks, and how many expressions want them."""
    names = expressions.select("id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("users")).join(known.select("name").distinct(), "name", "left_anti")
