"""Strongly connected components, a cycle to show for each, and chains followed to their ends, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import Rounds, counted, cut


#: Peeling goes on while a round takes at least one link in so many.
WORTH_PEELING = 10


def _trimmed(links: DataFrame) -> tuple[DataFrame, int]:
    """Links between nodes that have links both in and out, repeatedly while that takes many; it only spares later rounds."""
    links, n = counted(links)
    while n:
        starts, ends = links.select(F.col("from_id").alias("to_id")), links.select(F.col("to_id").alias("from_id"))
        links, m = counted(links.join(ends, "from_id", "left_semi").join(starts, "to_id", "left_semi").select("from_id", "to_id"))
        if (n - m) * WORTH_PEELING < n:
            return links, m
        n = m
    return links, n


def _coloured(links: DataFrame) -> DataFrame:
    """(id, above, below): the smallest id that reaches each end of ``links``, and the smallest that it reaches, itself included.

    A round passes on, both ways, only what the one before made smaller.
    """
    way = lambda a, b, up: links.select(F.col(a).alias("id"), F.col(b).alias("to"), F.lit(up).alias("up"))
    both = cut(way("from_id", "to_id", True).unionByName(way("to_id", "from_id", False)))
    now, changed = counted(both.select("id").distinct().select("id", F.col("id").alias("above"), F.col("id").alias("below"), F.lit(True).alias("new")))
    while changed:
        told = now.where("new").join(both, "id").groupBy(F.col("to").alias("id")).agg(F.min(F.when(F.col("up"), F.col("above"))).alias("a"), F.min(F.when(~F.col("up"), F.col("below"))).alias("b"))
        lower = F.coalesce(F.col("a") < F.col("above"), F.lit(False)) | F.coalesce(F.col("b") < F.col("below"), F.lit(False))
        now, changed = counted(now.join(told, "id", "left").select("id", F.least("above", "a").alias("above"), F.least("below", "b").alias("below"), lower.alias("new")), F.count_if("new"))
    return now.select("id", "above", "below")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, cycle): the objects on cycles, self loops too, and the smallest id that lies on cycles with each.

    Every node learns the smallest id that reaches it and the smallest that it reaches. If both are one id, the node lies in
    that id's component. Links whose ends learned different pairs lie on no cycle; the others, between nodes not
    yet settled, go round again. State is a row per node, and each round's work that of the links it follows; there
    is no table of pairs.
    """
    links, n = _trimmed(edges.select("from_id", "to_id").dropna().distinct())
    loops = cut(links.where("from_id = to_id").select(F.col("from_id").alias("id")))
    done = Rounds(loops.limit(0).select("id", F.col("id").alias("cycle")))
    while n:
        colours = _coloured(links)
        members = cut(colours.where("above = below").select("id", F.col("above").alias("cycle")))
        whole = members.groupBy("cycle").count().where("count > 1").select("cycle").union(members.join(loops, "id", "left_semi").select("cycle")).distinct()
        done.add(members.join(whole, "cycle", "left_semi").select("id", "cycle"))
        left = colours.where("above <> below")
        of = lambda end: left.select(F.col("id").alias(end), "above", "below")
        links, n = _trimmed(links.join(of("from_id"), "from_id").join(of("to_id"), ["to_id", "above", "below"]).select("from_id", "to_id"))
    return done.all()


def shortest_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(cycle, place, id) of a shortest cycle through the smallest node of each of ``components`` (id, cycle), that node first and last.

    All components are searched at once, breadth first from their smallest nodes, each node once; of
    equally short cycles the smallest predecessors tell, from the end back.
    """
    of = lambda end: components.select(F.col("id").alias(end), "cycle")
    links = cut(edges.select("from_id", "to_id").distinct().join(of("from_id"), "from_id").join(of("to_id"), ["to_id", "cycle"]).select("cycle", "from_id", "to_id"))
    on = links.where("to_id <> cycle").withColumnRenamed("from_id", "id")
    found, at = Rounds(components.where("id = cycle").select("cycle", "id", F.lit(None).cast("string").alias("before"), F.lit(0).alias("depth"))), 0
    frontier = found.all()
    while found.added:
        at += 1
        step = frontier.join(on, ["cycle", "id"]).groupBy("cycle", F.col("to_id").alias("id")).agg(F.min("id").alias("before"))
        frontier = found.add(step.select("cycle", "id", "before", F.lit(at).alias("depth")).join(found.all(), ["cycle", "id"], "left_anti"))
    tree = cut(found.all())
    closing = tree.join(links.where("to_id = cycle").select("cycle", F.col("from_id").alias("id")), ["cycle", "id"]).groupBy("cycle").agg(F.min(F.struct("depth", "id", "before")).alias("e"))
    way = Rounds(closing.select("cycle", F.col("e.depth").alias("place"), "e.id", "e.before"))
    ends = way.all().select("cycle", (F.col("place") + 1).alias("place"), F.col("cycle").alias("id"))
    frontier = way.all()
    while way.added:
        up = frontier.where("place > 0").select("cycle", (F.col("place") - 1).alias("place"), F.col("before").alias("id"))
        frontier = way.add(up.join(tree.select("cycle", "id", "before"), ["cycle", "id"]).select("cycle", "place", "id", "before"))
    return way.all().select("cycle", "place", "id").unionByName(ends)


def ends_of(steps: DataFrame) -> DataFrame:
    """(id, end): where each of ``steps`` (id, next, done) leads; ``done`` says that ``next`` is an end.

    Pointers double each round, so rounds are the logarithm of the longest chain. What leads to an absent id, or
    round and round, has no end.
    """
    jump, n = counted(steps.select("id", "next", "done"))
    found, open_, left, span = Rounds(jump.where("done").select("id", F.col("next").alias("end"))), jump.where("NOT done"), 1, 1
    while left and span <= n:
        further = jump.select(F.col("id").alias("next"), F.col("next").alias("further"), "done")
        new = cut(open_.select("id", "next").join(further, "next").select("id", F.col("further").alias("next"), "done"))
        found.add(new.where("done").select("id", F.col("next").alias("end")))
        open_, left = counted(new.where("NOT done"))
        jump = found.all().select("id", F.col("end").alias("next"), F.lit(True).alias("done")).unionByName(open_)
        span *= 2
    return found.all()


def paths_to_ends(steps: DataFrame) -> DataFrame:
    """(id, path): the ``step`` of every id on the way from its end down to it, for ``steps`` (id, next, done, step) whose ways all end."""
    jump, left = counted(steps.select("id", "next", "done", F.array("step").alias("path")))
    found, open_ = Rounds(jump.where("done").select("id", "path")), jump.where("NOT done")
    while left:
        further = jump.select(F.col("id").alias("next"), F.col("next").alias("further"), "done", F.col("path").alias("above"))
        new = cut(open_.select("id", "next", "path").join(further, "next").select("id", F.col("further").alias("next"), "done", F.concat("above", "path").alias("path")))
        found.add(new.where("done").select("id", "path"))
        open_, left = counted(new.where("NOT done"))
        jump = found.all().select("id", F.lit(None).cast("string").alias("next"), F.lit(True).alias("done"), "path").unionByName(open_)
    return found.all()
