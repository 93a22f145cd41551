"""What a change plan breaks in its target, what it needs from donors, and which sibling reports it touches.

A walk's state is (origin, side, id): the plan row it started from, the graph it is in, and the object reached. Alignment
rows lead from a donor's object to the target's, where what was reached is settled. State grows with what is reached per
plan row, which is the answer; an object reached twice for a row is followed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import fold
from weftgraph.functions.lineage import Rounds, cut

#: What a person can say of something needed. Fixed values.
MAPPED, ADDED, DROPPED = "map_to_target", "add_from_donor", "drop_added_object"
ITEM = ["direction", "cause", "source", "object_id", "severity", "certainty", "blocking", "path"]


def reach(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(origin, side, id, depth, path, again) of all that each of ``seeds`` (origin, side, id) reaches along ``links`` (side, at, id).

    A path is a shortest one, of equally short ones that over the smallest predecessors. A seed that is reached again
    has one more row, ``again``, with the way round to it. Rounds find and keep only what the walk goes on from; what no link
    leads on from is taken from there in a last step, which is not written and tells no paths that nobody asks for.
    """
    on = ["origin", "side", "id"]
    links = cut(links.select("side", "at", "id").dropna())
    tails = cut(links.select("side", F.col("at").alias("id"), F.lit(True).alias("goes")).distinct())
    links = cut(links.join(tails, ["side", "id"], "left").select("side", "at", "id", F.coalesce("goes", F.lit(False)).alias("goes")))
    inner, last = links.where("goes").drop("goes"), links.where("NOT goes").drop("goes")
    first = seeds.select(*on).dropna().distinct()
    found = Rounds(first.select("*", F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit(False).alias("again")))
    frontier, at, starts = found.all(), 0, cut(first.select(*on, F.lit(True).alias("start")))
    while found.added:
        at += 1
        step = frontier.where("NOT again").select("origin", "side", F.col("id").alias("at"), "path").join(inner, ["side", "at"])
        best = step.groupBy(*on).agg(F.min(F.struct("at", "path")).alias("b"))
        new = best.join(found.all().where("depth > 0").select(*on), on, "left_anti").join(starts, on, "left")
        told = new.select(*on, F.lit(at).alias("depth"), F.concat("b.path", F.array("id")).alias("path"), F.coalesce("start", F.lit(False)).alias("again"))
        frontier = found.add(told)
    step = found.all().where("NOT again").select("origin", "side", F.col("id").alias("at"), "depth", "path").join(last, ["side", "at"])
    best = step.groupBy(*on).agg((F.min("depth") + 1).alias("depth"), F.min(F.struct("depth", "at", "path"))["path"].alias("path")).join(starts, on, "left")
    return found.all().unionByName(best.select(*on, "depth", F.concat("path", F.array("id")).alias("path"), F.coalesce("start", F.lit(False)).alias("again")))


def needs(adds: DataFrame, objects: DataFrame, links: DataFrame, target: DataFrame, alignment: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """Items for what rows added from donors need and the target lacks, however far up.

    ``adds`` are (row_key, source), the key being the donor's; ``objects`` (source, id, name) and ``links`` (source, from_id, to_id: the first needs the
    second) the donors'; ``target`` (id, name); ``alignment`` (source, id, target_id). An object is there if it is aligned with an object of the target or
    bears an id of one. Else it clashes with an object of its name, will be added by another row, or is missing, unless ``said`` (object_id,
    action) maps it, adds it or drops what needs it. The walk goes on behind objects that are there. Rows whose donor lacks the key need nothing.
    """
    own = objects.select(F.col("source").alias("side"), "id", "name")
    known = own.select("side", "id")
    inner = links.select(F.col("source").alias("side"), F.col("from_id").alias("at"), F.col("to_id").alias("id")).join(known, ["side", "id"], "left_semi").join(known.withColumnRenamed("id", "at"), ["side", "at"], "left_semi")
    seeds = adds.select(F.col("row_key").alias("origin"), F.col("source").alias("side"), F.col("row_key").alias("id")).join(known, ["side", "id"], "left_semi")
    ids = target.select("id").distinct()
    aligned = alignment.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source").alias("side"), "id")
    lacking = own.join(aligned, ["side", "id"], "left_anti").join(ids, "id", "left_anti")
    taken = target.select(fold(F.col("name")).alias("folded"), F.lit(True).alias("clash")).dropna().distinct()
    added = adds.select(F.col("row_key").alias("id"), F.lit(True).alias("added")).distinct()
    told = lacking.withColumn("folded", fold(F.col("name"))).join(taken, "folded", "left").join(added, "id", "left")
    severity = F.when(F.col("clash"), "name_clash").when(F.col("added"), "will_be_added").otherwise("missing")
    action = F.lit(None).cast("string")
    if said is not None:
        told = told.join(said.groupBy(F.col("object_id").alias("id")).agg(F.min("action").alias("action")), "id", "left")
        action = F.col("action")
    settled = F.when(action == MAPPED, "mapped").when(action == ADDED, "will_be_added").otherwise(severity)
    blocking = settled.isin("name_clash", "missing") & ~F.coalesce(action == DROPPED, F.lit(False))
    told = cut(told.select("side", "id", settled.alias("settled"), blocking.alias("blocking")))  # an object's verdict is the same for all rows that need it
    found = reach(inner, seeds).where("depth > 0").join(told, ["side", "id"])
    return _items(found, "needs", F.col("origin"), F.col("side"), F.col("settled"), F.lit("certain"), F.col("blocking"))


def breaks(changes: DataFrame, target: DataFrame, links: DataFrame, policies: DataFrame | None = None, included: DataFrame | None = None) -> DataFrame:
    """Items for what uses the changed objects, directly or through others.

    ``changes`` are (row_key, object_id, change: deleted, renamed or modified), ``links`` (from_id, to_id, fact: the first uses the second). An item is
    certain if a way of facts alone leads to it, by such a way; else possible, to be reviewed, and never blocking. Certain ones block where
    the row's removal policy (``policies``: row_key, policy) is to block, as it is without one, and where a renamed object's user is
    not ``included`` (row_key, object_id) in the rewrite. Changed objects that the target lacks break nothing.
    """
    ids = target.select("id").distinct()
    own = changes.join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    sides = F.when(F.col("fact"), F.array(F.lit("sure"), F.lit("every"))).otherwise(F.array(F.lit("every")))  # both walks in one, as two graphs
    seeds = own.select(F.col("row_key").alias("origin"), F.explode(F.array(F.lit("sure"), F.lit("every"))).alias("side"), F.col("object_id").alias("id"))
    back = links.select(F.explode(sides).alias("side"), F.col("to_id").alias("at"), F.col("from_id").alias("id"))
    walked = reach(back, seeds).where("depth > 0 AND NOT again").withColumn("sure", F.col("side") == "sure")
    both = walked.groupBy("origin", "id").agg(F.max("sure").alias("sure"), F.min(F.struct(~F.col("sure"), "path"))["path"].alias("path"))
    kind = own.groupBy(F.col("row_key").alias("origin")).agg(F.min("change").alias("change"))
    policy, rewritten = F.lit("block"), F.lit(False)
    if policies is not None:
        kind = kind.join(policies.groupBy(F.col("row_key").alias("origin")).agg(F.min("policy").alias("policy")), "origin", "left")
        policy = F.coalesce("policy", policy)
    told = both.join(cut(kind), "origin")
    if included is not None:
        told = told.join(included.select(F.col("row_key").alias("origin"), F.col("object_id").alias("id"), F.lit(True).alias("rewritten")).distinct(), ["origin", "id"], "left")
        rewritten = F.coalesce("rewritten", rewritten)
    sure, change = F.col("sure"), F.col("change")
    severity = F.when(~sure, "needs_review").when(change.isin("deleted", "renamed"), "breaks").otherwise("changes_value")
    blocking = sure & (((change == "deleted") & (policy == "block")) | ((change == "renamed") & ~rewritten))
    return _items(told, "breaks", F.col("origin"), F.lit(None).cast("string"), severity, F.when(sure, "certain").otherwise("possible"), blocking)


def siblings(changes: DataFrame, fields: DataFrame) -> DataFrame:
    """Items for the visuals of other reports (``fields``: source, object_id, field) that use a deleted object, by id or by the last part of it."""
    last = lambda c: F.substring_index(c, "/", -1)
    gone = changes.where("change = 'deleted'").select(F.col("object_id").alias("gone")).distinct()
    used = fields.select("source", "object_id", "field").dropna().distinct()
    by_id = used.join(gone, F.col("field") == F.col("gone"), "left_semi")
    named = gone.where("contains(gone, '/')").select(last(F.col("gone")).alias("last")).distinct()
    by_name = used.withColumn("last", last(F.col("field"))).join(named, "last", "left_semi").select(*used.columns)
    told = by_id.union(by_name).distinct().select("*", F.array("object_id").alias("path")).withColumnRenamed("object_id", "id")
    return _items(told, "siblings", F.col("field"), F.col("source"), F.lit("not_changed_by_this_plan"), F.lit("certain"), F.lit(False))


def _items(rows: DataFrame, direction: str, cause: Column, source: Column, severity: Column, certainty: Column, blocking: Column) -> DataFrame:
    return rows.select(F.lit(direction).alias("direction"), cause.alias("cause"), source.alias("source"), F.col("id").alias("object_id"), severity.alias("severity"), certainty.alias("certainty"), blocking.alias("blocking"), "path")
