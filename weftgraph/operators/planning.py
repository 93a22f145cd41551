"""A plan of changes from choices: which are valid, what is removed with what, names after the plan, order, edits, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.keys import fold
from weftgraph.functions.lineage import Rounds, cut
from weftgraph.operators.edits import LEVELS, highest, risk
from weftgraph.operators.traversal import layers

# Fixed values.
CHOICES = ["keep", "take", "take_properties", "add_new_name", "remove", "skip", "promote", "copy_to_report", "edit"]
IDLE = ["keep", "skip"]
FROM_SOURCE = ["take", "take_properties", "add_new_name", "promote", "copy_to_report"]
WITH_PROPERTIES = ["measure", "column", "relationship"]
PHASES = ["deletes", "renames", "creates", "changes", "rewrites"]
PHASE_OF = {
    "DELETE": "deletes", "RENAME": "renames", "RENAME_PAIR": "renames", "CREATE": "creates", "REPLACE": "changes", "SET_PROPERTIES": "changes", "REWRITE_EXPRESSION": "rewrites",
    "DELETE_PAGE": "deletes", "DELETE_VISUAL": "deletes", "DELETE_REPORT_MEASURE": "deletes", "REMOVE_FIELD": "deletes", "COPY_PAGE": "creates", "COPY_VISUAL": "creates",
    "CREATE_REPORT_MEASURE": "creates", "REPLACE_REPORT_MEASURE": "changes", "REBIND_FIELD": "rewrites",
}
TYPE_ORDER = ["expression", "table", "column", "partition", "relationship", "hierarchy", "function", "measure", "calculation_group", "calculation_item", "role", "page", "visual", "report_measure"]
GATES = {"security": "SECURITY_VIOLATION", "scope": "UNAUTHORIZED_MUTATION", "baseline": "BASELINE_MISMATCH", "source": "SOURCE_INTEGRITY_FAILURE", "static": "STRUCTURAL_VALIDATION_FAILURE"}
FOLDED = ["measure", "column"]


def _place(values: list[str], c: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, values)), c)
    return F.when(at > 0, at - 1).otherwise(len(values)).cast("int")


def judged_choices(rows: DataFrame, choices: DataFrame, sources: list[str], target: str) -> DataFrame:
    """(row_key, choice, source_id, reason) of the choices that do something; ``reason`` is null where the choice is possible.

    ``rows`` (row_key, object_type, in_target, sources: array of the sources that have the object), ``choices`` (row_key, choice,
    source_id, properties, new_name). One on a source that left the session is ``choice_source_removed``; one on no row is left out
    otherwise.
    """
    work = choices.where(F.col("choice").isNotNull() & ~F.col("choice").isin(IDLE))
    both = work.join(rows, "row_key", "left")
    of_source = F.col("choice").isin(FROM_SOURCE)
    gone = of_source & ~F.coalesce(F.col("source_id").isin(sources), F.lit(False))
    held = F.coalesce(F.array_contains("sources", F.col("source_id")), F.lit(False))
    takes = F.col("choice") == "take_properties"
    blank = F.coalesce(F.trim("new_name"), F.lit("")) == ""
    reason = (
        F.when(gone, "choice_source_removed")
        .when(~F.col("choice").isin(CHOICES), "unknown_kind")
        .when(of_source & ~held, "no_source_object")
        .when(of_source & (F.col("source_id") == target) & (F.col("choice") != "promote"), "source_is_target")
        .when(F.col("choice").isin("take_properties", "remove", "edit") & ~F.coalesce("in_target", F.lit(False)), "no_target_object")
        .when(takes & (~F.col("object_type").isin(WITH_PROPERTIES) | (F.coalesce(F.size("properties"), F.lit(0)) < 1)), "no_properties")
        .when((F.col("choice") == "add_new_name") & blank, "new_name_required")
        .when(F.col("choice").isin("promote", "copy_to_report") & (F.col("object_type") != "report_measure"), "report_measure_only")
    )
    return both.where(F.col("object_type").isNotNull() | gone).select("row_key", "choice", "source_id", reason.alias("reason"))


def removals(objects: DataFrame, uses: DataFrame, fields: DataFrame, removed: DataFrame, kept: DataFrame) -> dict[str, DataFrame]:
    """What removing objects takes along: ``deleted`` (id, because), ``fields`` (owner, id) that lose a field, ``blocked`` (id, removed, policy).

    ``objects`` (id, parent_id), ``uses`` (owner, id) by formula or structure, ``fields`` (owner, id) by visuals, ``removed`` (id, policy,
    repoint: a kept object or null), ``kept`` (id) with a choice of their own. A removed object takes its children. Under ``cascade`` what
    uses it goes too, and so on; under ``repoint`` uses are rewritten and only visuals' fields are told elsewhere; else a use that
    stays blocks.
    """
    children = cut(objects.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.col("id").alias("child")))
    links = cut(uses.select("id", "owner").distinct())
    policy = F.when((F.col("policy") == "repoint") & F.col("repoint").isNull(), "block").otherwise(F.coalesce("policy", F.lit("block")))
    found = Rounds(removed.select("id", F.col("id").alias("because"), policy.alias("policy")).distinct())
    frontier = found.all()
    while not frontier.isEmpty():
        below = frontier.join(children, "id").select(F.col("child").alias("id"), "because", "policy")
        users = frontier.where("policy = 'cascade'").join(links, "id").select(F.col("owner").alias("id"), "because", "policy").join(kept, "id", "left_anti")
        # what one policy has reached another may reach later, and go on from
        new = below.union(users).groupBy("id", "policy").agg(F.min("because").alias("because")).select("id", "because", "policy")
        frontier = found.add(new.join(found.all().select("id", "policy"), ["id", "policy"], "left_anti"))
    gone = cut(found.all().groupBy("id").agg(F.min(F.struct("because", "policy")).alias("b")).select("id", "b.*"))
    ids = gone.select("id")
    stays = links.join(gone, "id").join(ids.select(F.col("id").alias("owner")), "owner", "left_anti").join(kept.select(F.col("id").alias("owner")), "owner", "left_anti")
    on_fields = fields.select("id", "owner").distinct().join(gone, "id").join(ids.select(F.col("id").alias("owner")), "owner", "left_anti")
    blocked = stays.where("policy = 'block'").unionByName(on_fields.where("policy = 'block'")).select(F.col("owner").alias("id"), F.col("id").alias("removed"), "policy").distinct()
    return {"deleted": gone.select("id", "because"), "fields": on_fields.where("policy = 'cascade'").select("owner", "id"), "blocked": blocked}


def name_clashes(objects: DataFrame, deleted: DataFrame, new_names: DataFrame, created: DataFrame, space: list[str]) -> DataFrame:
    """(id, name, others) of new or renamed objects whose name, folded, others of their name space bear after the plan.

    ``objects`` and ``created`` have id, name and the ``space`` columns; ``new_names`` (id, new_name). Names are counted per space.
    """
    live = objects.join(deleted.select("id"), "id", "left_anti").join(new_names, "id", "left")
    after = live.select("id", F.coalesce("new_name", "name").alias("name"), *space, (F.col("new_name").isNotNull() & (fold(F.col("new_name")) != fold(F.col("name")))).alias("changed"))
    every = after.unionByName(created.select("id", "name", *space, F.lit(True).alias("changed"))).withColumn("k", fold(F.col("name")))
    taken = every.groupBy(*space, "k").agg(F.count("*").alias("n")).where("n > 1")
    return every.where("changed").join(taken, [*space, "k"]).select("id", "name", (F.col("n") - 1).alias("others"))


def ordered(operations: DataFrame, needs: DataFrame) -> DataFrame:
    """(place, operation_id, op, cyclic) of operations in the order they run; model before report, five phases each, needs first.

    ``operations`` (operation_id, domain, op, object_type, object_id), ``needs`` (operation_id, needed). Within a phase what is needed
    comes first, in deletes last; ties go by type, object and id. Operations on or behind a cycle come last in their phase, marked.
    """
    phases = F.create_map(*[F.lit(x) for pair in PHASE_OF.items() for x in pair])
    own = cut(operations.withColumn("phase", F.when(F.col("domain") == "model", 0).otherwise(len(PHASES)) + _place(PHASES, phases[F.col("op")])))
    at = own.select("operation_id", "phase")
    same = needs.join(at, "operation_id").join(at.toDF("needed", "needed_phase"), "needed").where("phase = needed_phase")
    deletes = F.col("phase") % len(PHASES) == 0
    edges = same.select(F.when(deletes, F.col("operation_id")).otherwise(F.col("needed")).alias("from_id"), F.when(deletes, F.col("needed")).otherwise(F.col("operation_id")).alias("to_id"))
    order, left = layers(edges, own.select(F.col("operation_id").alias("id")))
    told = own.join(order.withColumnRenamed("id", "operation_id"), "operation_id", "left").join(left.select(F.col("id").alias("operation_id"), F.lit(True).alias("cyclic")), "operation_id", "left")
    from weftgraph.operators.regression import placed

    keyed = told.withColumns({"cyclic": F.coalesce("cyclic", F.lit(False)), "layer": F.coalesce("layer", F.lit(1 << 30)), "rank": _place(TYPE_ORDER, F.col("object_type"))})
    rows = placed(keyed.select("phase", "layer", "rank", "object_id", "operation_id", "op", "cyclic"), ["phase", "layer", "rank", "object_id", "operation_id"])
    return rows.select("place", "row.operation_id", "row.op", "row.cyclic")


def edited(objects: DataFrame, kind: str, prop: str | None = None, value: str | None = None) -> DataFrame:
    """(id, property, old, new, skipped) of a bulk edit: ``set_property``, ``move_folder`` or ``delete``; ``skipped`` says why a row is left.

    ``objects`` (id, object_type, display_folder and further text columns). Texts are trimmed; an empty one is none.
    """
    if kind == "delete":
        return objects.select("id", F.lit("$object").alias("property"), F.col("id").alias("old"), F.lit(None).cast("string").alias("new"), F.lit(None).cast("string").alias("skipped"))
    name = "display_folder" if kind == "move_folder" else prop
    new = F.lit((value or "").strip() or None).cast("string")
    reason = F.when(F.lit(kind == "move_folder") & ~F.col("object_type").isin(FOLDED), "no_folder").when(F.col(name).eqNullSafe(new), "no_change")
    return objects.select("id", F.lit(name).alias("property"), F.col(name).alias("old"), F.when(reason.isNull(), new).alias("new"), reason.alias("skipped"))


def gated(mutations: DataFrame, evidence: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(change_id, risk, reasons, decision) of changes with mutations (change_id, object_type, property) and evidence (change_id, gate, status).

    The risk is the highest of the mutations', where ``overrides`` ("TYPE:property") may set one. A gate that did not pass is a
    reason; impact must have run unless the risk is low, and a run be verified if it is high or critical. A failed gate rejects, an open
    one leaves it INCONCLUSIVE; a high risk that passed all still wants an approval (gate ``approval``).
    """
    own = F.concat_ws(":", "object_type", "property")
    given = F.create_map(*[F.lit(x) for pair in (overrides or {"": "LOW"}).items() for x in pair])
    levels = mutations.withColumn("level", F.coalesce(given[own], risk(F.col("object_type"), F.col("property"))))
    told = levels.groupBy("change_id").agg(highest(F.col("level")).alias("risk"))
    wide = evidence.groupBy("change_id").agg(*[F.max(F.when(F.col("gate") == g, F.col("status"))).alias(g) for g in [*GATES, "runtime", "impact", "approval"]])
    both = told.join(wide, "change_id", "left")
    high = F.col("risk").isin(LEVELS[2:])
    failed = lambda gate, code, when: F.when(when & (F.coalesce(F.col(gate), F.lit("NOT_RUN")) != "PASSED"), F.struct(F.lit(code).alias("code"), F.coalesce(F.col(gate), F.lit("NOT_RUN")).alias("status")))
    checks = [failed(g, code, F.lit(True)) for g, code in GATES.items()] + [failed("runtime", "REQUIRED_RUNTIME_NOT_VERIFIED", high), failed("impact", "IMPACT_NOT_RUN", F.col("risk") != "LOW")]
    reasons = F.array_compact(F.array(*checks))
    hard = F.exists("reasons", lambda r: r["status"].isin("FAILED", "REJECTED_SCOPE"))
    approved = F.coalesce(F.col("approval") == "PASSED", F.lit(False))
    decision = F.when(hard, "REJECT").when(F.size("reasons") > 0, "INCONCLUSIVE").when(high & ~approved, "APPROVAL_REQUIRED").otherwise("ALLOW")
    return both.withColumn("reasons", reasons).select("change_id", "risk", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("reasons"), decision.alias("decision"))
