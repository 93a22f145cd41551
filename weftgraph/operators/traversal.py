"""Walks over (from_id, to_id, type) edges as rounds of joins on a frontier.

The edges that a walk needs are written once; each round joins the frontier to them, drops what
was seen and is appended in the shared checkpoint folder, so plans stay small, no round scans the
sources again, and a lost executor does not restart the walk.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import MOST_ROUNDS, Rounds, counted, cut
from weftgraph.operators.components import ends_of


def neighbours(edges: DataFrame, nodes: DataFrame, of: str) -> DataFrame:
    """The distinct nodes one edge away, either way."""
    out = edges.where(F.col("from_id") == of).select(F.col("to_id").alias("id"))
    into = edges.where(F.col("to_id") == of).select(F.col("from_id").alias("id"))
    return nodes.join(out.union(into).distinct(), "id", "left_semi")


def either_way(edges: DataFrame) -> DataFrame:
    return edges.select("from_id", "to_id", "type").union(edges.select(F.col("to_id"), F.col("from_id"), "type"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int | None, ends: tuple[str, ...] = ()) -> DataFrame:
    """(id, depth) of all that ``seeds`` (id) reach along the edges within ``depth`` rounds, or at all.

    An edge whose type is in ``ends`` is followed, but the walk stops behind it.
    """
    # a node reached only by an ending edge in one round may go on if another edge reaches it later
    links = cut(edges.select("from_id", "to_id", (F.col("type").isin(*ends) if ends else F.lit(False)).alias("ending")))
    found = Rounds(seeds.select("id", F.lit(0).alias("depth"), F.lit(False).alias("stopped")).distinct())
    frontier, at = found.all(), 0
    while depth is None or at < depth:
        at += 1
        step = frontier.where("not stopped").join(links, frontier["id"] == links["from_id"]).groupBy(F.col("to_id").alias("id")).agg(F.min("ending").alias("stopped"))
        done = found.all()
        if ends:  # what only ending edges reached may be reached again
            done = done.groupBy("id").agg(F.min("stopped").alias("was_stopped"))
            step = step.join(done, "id", "left").where("was_stopped IS NULL OR (was_stopped AND NOT stopped)")
        else:
            step = step.join(done.select("id"), "id", "left_anti")
        frontier = found.add(step.select("id", F.lit(at).alias("depth"), "stopped"))
        if not found.added:
            break
    return found.all().groupBy("id").agg(F.min("depth").alias("depth"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are in ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def rounds(most: int | None) -> Iterable[int]:
    """1 up to ``most``, or without end."""
    return count(1) if most is None else range(1, most + 1)


def shortest_path(edges: DataFrame, start: str, goal: str, most: int | None = None) -> DataFrame:
    """(step, id) of a shortest directed path, of any length or up to ``most`` edges; among equal ones the smallest predecessor, from the goal back."""
    spark, links = edges.sparkSession, cut(edges.select("from_id", "to_id"))
    found = Rounds(spark.createDataFrame([(start, None, 0)], "id string, before string, depth int"))
    frontier = found.all()
    for at in rounds(most):
        if start == goal or not frontier.where(F.col("id") == goal).isEmpty():
            break
        step = frontier.join(links, frontier["id"] == links["from_id"]).groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("before"))
        frontier = found.add(step.join(found.all().select("id"), "id", "left_anti").withColumn("depth", F.lit(at)))
        if not found.added:
            return spark.createDataFrame([], "step int, id string")
    path, now, seen = [], goal, found.all()
    while now is not None and (row := seen.where(F.col("id") == now).first()):
        path.append((row["depth"], row["id"]))
        now = row["before"]
    return spark.createDataFrame(sorted(path), "step int, id string")


def layers(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kahn's peel: (id, layer) of nodes in topological layers, and (id) of those behind a cycle.

    A round writes the nodes left with the number of links into them that are left, and takes those with none.
    """
    links = cut(edges.select("from_id", F.col("to_id").alias("id")).distinct())
    into = links.groupBy("id").agg(F.count("*").alias("n"))
    free = F.count_if(F.col("n") == 0)
    left, ready = counted(ids.select("id").distinct().join(into, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), free)
    done, at = [left.limit(0).select("id", F.lit(0).alias("layer"))], 0
    while ready:
        now = left.where("n = 0").select("id")
        done.append(now.select("id", F.lit(at).alias("layer")))
        if len(done) > MOST_ROUNDS:
            done = [cut(reduce(DataFrame.union, done))]
        less = now.withColumnRenamed("id", "from_id").join(links, "from_id").groupBy("id").agg(F.count("*").alias("less"))
        left, ready = counted(left.where("n > 0").join(less, "id", "left").select("id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")), free)
        at += 1
    return reduce(DataFrame.union, done), left.select("id")


def path_of_parents(nodes: DataFrame, ids: DataFrame, goal_types: list[str]) -> DataFrame:
    """(id, ancestor): for each of ``ids`` (id) the first object of ``goal_types`` up its ``parent_id`` chain, itself included; none if the chain ends or loops."""
    goal = F.col("type").isin(goal_types)
    steps = nodes.select("id", F.when(goal, F.col("id")).otherwise(F.col("parent_id")).alias("next"), goal.alias("done")).where("next IS NOT NULL AND (done OR next <> id)")
    return ends_of(steps).join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("end").alias("ancestor"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(end, id) for ends of edges that are no node."""
    ends = edges.select(F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("from_id").alias("id")), F.struct(F.lit("to").alias("end"), F.col("to_id").alias("id")))).alias("e")).select("e.*")
    return ends.distinct().join(nodes.select("id"), "id", "left_anti")


def orphans(edges: DataFrame, nodes: DataFrame, parents: dict[str, str]) -> DataFrame:
    """Nodes of the types in ``parents`` without a CONTAINS edge from a node of the type named there."""
    held = edges.where("type = 'CONTAINS'").join(nodes.select(F.col("id").alias("from_id"), F.col("type").alias("parent_type")), "from_id")
    wanted = F.create_map(*[x for kind, of in parents.items() for x in (F.lit(kind), F.lit(of))])
    own = nodes.where(F.col("type").isin(*parents)).withColumn("parent_type", wanted[F.col("type")])
    return own.join(held.select(F.col("to_id").alias("id"), "parent_type"), ["id", "parent_type"], "left_anti").select("id", "type")
