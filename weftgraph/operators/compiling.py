"""A change plan compiled from choices: operations in the order they run, with their texts, and what blocks them.

A row is one object across the sources, by its row key; each source may have it under a name and with a formula of its own.
Choices on rows begin operations; what the taken formulas need is looked for in the target as it will be, and what is lacking is
taken from its donor as well, whose formula needs more, and so on until a round adds nothing. Each round asks only for the
operations that the one before added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import fold
from weftgraph.functions.lineage import Rounds, cut
from weftgraph.operators import merge, planning
from weftgraph.operators.walks import DROPPED, MAPPED

#: What becomes of something needed, the first that holds. Fixed values.
OUTCOMES = ["removed", "exists", "dropped", "mapped", "missing", "clash", "add"]
BLOCKERS = {"removed": "removed", "missing": "need_missing", "clash": "need_clash"}
NEW = "#new"  #: what tells a row added under a new name from the row it was taken from


def compile_plan(rows: DataFrame, cells: DataFrame, links: DataFrame, choices: DataFrame, target: str, said: DataFrame, included: DataFrame) -> DataFrame:
    """(kind, place, what, object_id, cause, text) of the plan: kind ``operation``, ``blocking`` or ``warning``.

    ``rows`` (row_key, object_type), ``cells`` (source, row_key, name, table, formula) of all sources, ``links`` (source, from_row, to_row: the
    first's formula needs the second), ``choices`` (row_key, choice, source_id, new_name, properties, policy, repoint), one a row; ``said`` (row_key, action,
    target_row) of needs, ``included`` (row_key, cause) of rewrites. Operations: DELETE what is removed and, by policy, what goes with it; RENAME; CREATE
    and REPLACE with the donor's formula in the target's names; REWRITE_EXPRESSION of target formulas that name what is renamed, if
    included. Something needed that the plan deletes, that no donor has or its row's choice keeps out, or whose name another row bears, blocks; one
    taken along is a warning. A need said to be dropped drops the operation that needs it, and what blocked that. Of rows that would bring one
    name in one round the smallest key does.
    """
    cells, links = cut(cells), cut(links.dropna().distinct())
    own = cells.where(F.col("source") == target).drop("source")
    has = cells.groupBy("row_key").agg(F.collect_set("source").alias("sources"), F.max(F.col("source") == target).alias("in_target"))
    known = rows.join(has, "row_key", "left")
    sources = [r["source"] for r in cells.select("source").distinct().collect()]  # a row for each source
    judged = cut(planning.judged_choices(known, choices, sources, target).join(choices.select("row_key", "new_name", "policy", "repoint"), "row_key", "left").join(rows, "row_key", "left"))
    valid = judged.where("reason IS NULL")
    idle = choices.where(F.col("choice").isin(planning.IDLE)).select("row_key").distinct()

    mine = links.where(F.col("source") == target).join(own.select(F.col("row_key").alias("from_row")), "from_row", "left_semi").select("from_row", "to_row")
    uses = mine.select(F.col("from_row").alias("owner"), F.col("to_row").alias("id"))
    removed = valid.where("choice = 'remove'").select(F.col("row_key").alias("id"), "policy", "repoint")
    kept = valid.where("choice <> 'remove'").select(F.col("row_key").alias("id"))
    gone = planning.removals(own.select(F.col("row_key").alias("id"), F.lit(None).cast("string").alias("parent_id")), uses, uses.limit(0), removed, kept)
    deleted = cut(gone["deleted"].select(F.col("id").alias("row_key")).distinct())

    renamed = cut(valid.where("choice = 'edit' AND new_name IS NOT NULL").select("row_key", "new_name").join(deleted, "row_key", "left_anti").join(own.select("row_key", "name", "formula"), "row_key").where(fold(F.col("new_name")) != fold(F.col("name"))))
    alive = cut(own.join(deleted, "row_key", "left_anti").join(renamed.select("row_key", "new_name"), "row_key", "left").join(rows, "row_key").select("row_key", "object_type", "table", F.coalesce("new_name", "name").alias("name"), "formula"))
    there = alive.select("row_key", F.lit(True).alias("there"))
    taken = valid.where("choice IN ('take', 'add_new_name')").join(there, "row_key", "left")
    fresh = F.col("choice") == "add_new_name"
    begun = cut(taken.select(F.when(fresh, F.concat("row_key", F.lit(NEW))).otherwise(F.col("row_key")).alias("object_id"), "row_key", F.col("source_id").alias("source"), F.when(fresh, F.col("new_name")).alias("new_name"), F.when(fresh | F.col("there").isNull(), "CREATE").otherwise("REPLACE").alias("op")))
    space = ["object_type", F.coalesce(fold(F.col("table")), F.lit("")).alias("in_table"), fold(F.col("name")).alias("folded")]
    brought = lambda df: df.join(cells, ["source", "row_key"]).join(rows, "row_key").withColumn("name", F.coalesce("new_name", "name"))

    made, names = Rounds(begun), Rounds(alive.select(*space).union(brought(begun.where("op = 'CREATE'")).select(*space)).distinct())
    needs = Rounds(begun.limit(0).select("object_id", "source", F.col("row_key").alias("needed"), F.lit("").alias("outcome"), F.lit("").alias("target_row")))
    frontier = made.all()
    firm = cut(said.groupBy("row_key").agg(F.min("action").alias("action"), F.min("target_row").alias("target_row")).join(there.withColumnRenamed("row_key", "target_row"), "target_row", "left").select(F.col("row_key").alias("needed"), "action", F.when(F.col("there"), F.col("target_row")).alias("target_row")))
    donors = cells.where(F.col("source") != target).select("source", F.col("row_key").alias("needed"))
    other = cut(donors.groupBy("needed").agg(F.min("source").alias("other")))
    while made.added:
        asked = frontier.join(links.withColumnsRenamed({"from_row": "row_key", "to_row": "needed"}), ["source", "row_key"]).select("object_id", "source", "needed").distinct()
        flag = lambda df, name: df.select(F.col("row_key").alias("needed"), F.lit(True).alias(name)).distinct()
        told = asked.join(flag(deleted, "gone"), "needed", "left").join(flag(there.union(made.all().where("new_name IS NULL").select("row_key", F.lit(True))), "there"), "needed", "left")
        told = told.join(firm, "needed", "left").join(flag(idle, "idle"), "needed", "left").join(donors.withColumn("own", F.lit(True)), ["source", "needed"], "left").join(other, "needed", "left")
        donor = F.when(F.col("own"), F.col("source")).otherwise(F.col("other"))
        outcome = (
            F.when(F.col("gone"), "removed").when(F.col("there"), "exists").when(F.col("action") == DROPPED, "dropped")
            .when((F.coalesce("action", F.lit(MAPPED)) == MAPPED) & F.col("target_row").isNotNull(), "mapped").when(F.col("idle") | donor.isNull(), "missing").otherwise("add")
        )
        told = cut(told.withColumn("donor", donor).withColumn("outcome", outcome))
        wanted = told.where("outcome = 'add'").groupBy(F.col("needed").alias("row_key")).agg(F.min("donor").alias("source"))
        named = wanted.join(cells, ["source", "row_key"]).join(rows, "row_key").select("row_key", "source", *space)
        first = F.row_number().over(Window.partitionBy("object_type", "in_table", "folded").orderBy("row_key")) == 1
        won = cut(named.withColumn("first", first).join(names.all().withColumn("borne", F.lit(True)), ["object_type", "in_table", "folded"], "left").withColumn("clash", ~F.col("first") | F.col("borne").isNotNull()))
        clashing = won.where("clash").select(F.col("row_key").alias("needed"), F.lit(True).alias("clash"))
        needs.add(told.join(clashing, "needed", "left").select("object_id", "source", "needed", F.when(F.col("clash"), "clash").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("outcome") == "mapped", F.col("target_row")).otherwise(F.col("needed")).alias("target_row")))
        names.add(won.where("NOT clash").select("object_type", "in_table", "folded"))
        frontier = made.add(won.where("NOT clash").select(F.col("row_key").alias("object_id"), "row_key", "source", F.lit(None).cast("string").alias("new_name"), F.lit("CREATE").alias("op")))

    needed = cut(needs.all())
    out = cut(needed.where("outcome = 'dropped'").select("object_id").distinct())
    made_ops = cut(made.all().join(out, "object_id", "left_anti"))
    standing = needed.join(out, "object_id", "left_anti")

    # names as they will be, for the texts taken over and for those that stay
    finals = alive.select("row_key", "name").union(brought(made.all().where("op = 'CREATE' AND new_name IS NULL")).select("row_key", "name"))
    said_as = cells.select("source", F.col("row_key").alias("needed"), F.col("name").alias("old"))
    none = F.lit(None).cast("string")
    moved = standing.join(said_as, ["source", "needed"]).join(finals.toDF("target_row", "final"), "target_row").select(F.col("object_id").alias("scope"), none.alias("table"), F.col("old").alias("name"), none.alias("new_table"), F.col("final").alias("new_name"))
    touched = mine.join(renamed.select(F.col("row_key").alias("to_row"), F.col("name").alias("old"), "new_name"), "to_row").join(there.select(F.col("row_key").alias("from_row")), "from_row", "left_semi").join(begun.where("op = 'REPLACE'").select(F.col("row_key").alias("from_row")), "from_row", "left_anti")
    agreed = included.select(F.col("row_key").alias("from_row"), F.col("cause").alias("to_row"), F.lit(True).alias("agreed")).distinct()
    touched = cut(touched.join(agreed, ["from_row", "to_row"], "left"))
    rewritten = touched.where("agreed").select(F.col("from_row").alias("scope"), none.alias("table"), F.col("old").alias("name"), none.alias("new_table"), "new_name")
    mark = lambda df: df.withColumn("scope", F.concat(F.lit("own:"), "scope"))
    texts = brought(made_ops).select(F.concat_ws("|", "op", "object_id").alias("id"), F.col("object_id").alias("scope"), "formula").union(
        alive.join(touched.where("agreed").select(F.col("from_row").alias("row_key")).distinct(), "row_key", "left_semi").select(F.concat(F.lit("REWRITE_EXPRESSION|"), "row_key").alias("id"), F.concat(F.lit("own:"), "row_key").alias("scope"), "formula")
    )
    done = merge.rewrite(cut(texts), cut(moved.unionByName(mark(rewritten)))).select(F.col("id").alias("operation_id"), F.col("new_formula").alias("text"), "changed")
    done = done.where("operation_id NOT LIKE 'REWRITE_EXPRESSION|%' OR changed > 0").drop("changed")

    one = lambda df, op, object_id, row_key: df.select(op.alias("op"), F.col(object_id).alias("object_id"), F.col(row_key).alias("row_key"))
    plain = one(deleted, F.lit("DELETE"), "row_key", "row_key").union(one(renamed, F.lit("RENAME"), "row_key", "row_key")).union(one(made_ops, F.col("op"), "object_id", "row_key"))
    plain = plain.union(one(touched.where("agreed").select("from_row").distinct(), F.lit("REWRITE_EXPRESSION"), "from_row", "from_row"))
    ops = plain.withColumn("operation_id", F.concat_ws("|", "op", "object_id")).join(done, "operation_id", "left").where("op <> 'REWRITE_EXPRESSION' OR text IS NOT NULL")
    ops = cut(ops.join(renamed.select("row_key", F.lit("RENAME").alias("op"), "new_name"), ["row_key", "op"], "left").withColumn("text", F.coalesce("new_name", "text")).join(rows, "row_key").select("operation_id", "op", "object_id", "object_type", "text"))
    ids = ops.select("object_id", "operation_id", "op")
    told_by = ids.where("op IN ('CREATE', 'REPLACE')").join(standing.select("object_id", F.col("target_row").alias("other")), "object_id").union(ids.where("op = 'DELETE'").join(mine.select(F.col("from_row").alias("object_id"), F.col("to_row").alias("other")), "object_id"))
    order = told_by.select("operation_id", F.col("other").alias("object_id")).join(ids.select("object_id", F.col("operation_id").alias("needed")), "object_id").select("operation_id", "needed").where("operation_id <> needed").distinct()
    placed = planning.ordered(ops.withColumn("domain", F.lit("model")), order).select("operation_id", "place", "cyclic")

    row = lambda df, kind, what, object_id, cause, place=F.lit(None).cast("long"), text=none: df.select(F.lit(kind).alias("kind"), place.alias("place"), what.alias("what"), F.col(object_id).alias("object_id"), cause.alias("cause"), text.alias("text"))
    codes = F.create_map(*[F.lit(x) for pair in BLOCKERS.items() for x in pair])
    clashes = planning.name_clashes(
        own.join(rows, "row_key").select(F.col("row_key").alias("id"), "name", "object_type", "table"), deleted.select(F.col("row_key").alias("id")), renamed.select(F.col("row_key").alias("id"), "new_name"),
        brought(made_ops.where("op = 'CREATE'")).select(F.col("object_id").alias("id"), "name", "object_type", "table"), ["object_type", "table"],
    )
    parts = [
        row(ops.join(placed, "operation_id"), "operation", F.col("op"), "object_id", none, F.col("place"), F.col("text")),
        row(ops.join(placed, "operation_id").where("cyclic"), "blocking", F.lit("dependency_cycle"), "object_id", none),
        row(judged.where("reason IS NOT NULL"), "blocking", F.col("reason"), "row_key", none),
        row(gone["blocked"], "blocking", F.lit("removal_blocked"), "id", F.col("removed")),
        row(standing.where(F.col("outcome").isin(*BLOCKERS)), "blocking", codes[F.col("outcome")], "object_id", F.col("needed")),
        row(standing.where("outcome = 'add'"), "warning", F.lit("need_added"), "object_id", F.col("needed")),
        row(touched.where("agreed IS NULL"), "blocking", F.lit("renamed"), "from_row", F.col("to_row")),
        row(clashes, "blocking", F.lit("name_clash"), "id", none),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
