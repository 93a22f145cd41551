"""Integrity of a metadata graph: one issue row per broken rule, from joins with small rule tables.

Every check returns (code, severity, object_id, edge_id, detail). Objects have id, type, status,
model_id, report_id, parent_id; links have id, type, from_id, to_id, source, confidence, status,
evidence_class, evidence. Nulls count as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import strong_components

# What may contain what, what must be contained by what, and the closed lists.
MODEL_OBJECTS = [
    "TABLE", "COLUMN", "MEASURE", "RELATIONSHIP", "FIELD_PARAMETER", "SHARED_EXPRESSION", "USER_DEFINED_FUNCTION", "CALCULATION_GROUP",
    "CALCULATION_ITEM", "HIERARCHY", "LEVEL", "PARTITION", "SECURITY_ROLE", "ROLE_FILTER", "OLS_PERMISSION",
]
REPORT_OBJECTS = ["PAGE", "VISUAL", "VISUAL_FILTER", "PAGE_FILTER", "REPORT_FILTER"]
FIELDS = [*MODEL_OBJECTS, "REPORT_MEASURE"]
FILTERS = ["VISUAL_FILTER", "PAGE_FILTER", "REPORT_FILTER", "ROLE_FILTER"]
EXPRESSIONS = ["MEASURE", "CALCULATION_ITEM", "SHARED_EXPRESSION", "USER_DEFINED_FUNCTION", "COLUMN", "REPORT_MEASURE", "ROLE_FILTER", "PARTITION"]
HOLDS = {
    "MODEL": MODEL_OBJECTS,
    "TABLE": ["COLUMN", "MEASURE", "HIERARCHY", "PARTITION", "CALCULATION_GROUP"],
    "CALCULATION_GROUP": ["CALCULATION_ITEM"],
    "HIERARCHY": ["LEVEL"],
    "SECURITY_ROLE": ["ROLE_FILTER", "OLS_PERMISSION"],
    "REPORT": ["PAGE", "REPORT_MEASURE", "BOOKMARK"],
    "PAGE": ["VISUAL", "PAGE_FILTER"],
    "VISUAL": ["VISUAL_FILTER"],
}
HELD_BY = {
    "TABLE": ["MODEL"], "RELATIONSHIP": ["MODEL"], "FIELD_PARAMETER": ["MODEL"], "SHARED_EXPRESSION": ["MODEL"], "USER_DEFINED_FUNCTION": ["MODEL"],
    "CALCULATION_GROUP": ["MODEL", "TABLE"], "HIERARCHY": ["TABLE"], "LEVEL": ["HIERARCHY"], "PARTITION": ["TABLE"], "SECURITY_ROLE": ["MODEL"],
    "ROLE_FILTER": ["SECURITY_ROLE"], "OLS_PERMISSION": ["SECURITY_ROLE"], "REPORT_MEASURE": ["REPORT"], "BOOKMARK": ["REPORT"], "COLUMN": ["TABLE"],
    "MEASURE": ["TABLE", "MODEL"], "CALCULATION_ITEM": ["CALCULATION_GROUP"], "PAGE": ["REPORT"], "VISUAL": ["PAGE"], "VISUAL_FILTER": ["VISUAL"],
    "PAGE_FILTER": ["PAGE"], "REPORT_FILTER": ["REPORT"],
}
STATUSES = ["factual", "candidate", "approved", "rejected", "overridden"]
EVIDENCE_CLASSES = ["FACT", "INFERRED", "OBSERVED"]


def _row(df: DataFrame, code: str, severity: str, object_id: str | None = None, edge_id: str | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    own = lambda c: none if c is None else F.col(c)
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), own(object_id).alias("object_id"), own(edge_id).alias("edge_id"), (none if detail is None else detail).alias("detail"))


def _issues(df: DataFrame, rules: list[tuple[str, str, Column]], object_id: str | None = None, edge_id: str | None = None) -> DataFrame:
    """Rules about single rows, in one scan: (code, severity, broken)."""
    none = F.lit(None).cast("string")
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, broken in rules]))
    own = lambda c: none if c is None else F.col(c)
    return df.select(F.explode(found).alias("f"), own(object_id).alias("object_id"), own(edge_id).alias("edge_id")).select("f.code", "f.severity", "object_id", "edge_id", none.alias("detail"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def integrity(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Identities, closed lists, provenance, agreement of evidence and status, dangling ends, orphans."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    status, kind = F.coalesce("status", F.lit("factual")), F.coalesce("evidence_class", F.lit("FACT"))
    about_objects = [
        ("missing_node_id", "BLOCKING", blank("id")),
        ("missing_node_type", "BLOCKING", blank("type")),
        ("invalid_node_status", "ERROR", ~F.lower(status).isin(STATUSES)),
    ]
    about_links = [
        ("missing_edge_id", "BLOCKING", blank("id")),
        ("missing_edge_type", "BLOCKING", blank("type")),
        ("missing_edge_endpoint", "BLOCKING", blank("from_id") | blank("to_id")),
        ("invalid_edge_status", "ERROR", ~F.lower(status).isin(STATUSES)),
        ("invalid_evidence_class", "ERROR", ~F.upper(kind).isin(EVIDENCE_CLASSES)),
        ("invalid_edge_confidence", "ERROR", ~F.coalesce("confidence", F.lit(1.0)).between(0, 1)),
        ("missing_edge_provenance", "ERROR", blank("source")),
        ("missing_edge_evidence", "WARNING", F.coalesce(F.size("evidence"), F.lit(0)) < 1),
        ("fact_status_mismatch", "ERROR", (kind == "FACT") & (status != "factual")),
        ("inference_status_mismatch", "ERROR", (kind == "INFERRED") & (status == "factual")),
        ("observed_type_mismatch", "ERROR", (kind == "OBSERVED") & (F.col("type") != "OBSERVED_WITH")),
        ("self_referential_edge", "WARNING", (F.col("from_id") == F.col("to_id")) & ~F.col("type").isin("SIMILAR_TO", "OBSERVED_WITH")),
    ]
    repeats = lambda df: df.where(F.col("id").isNotNull()).groupBy("id").count().where("count > 1")
    ends = links.select("id", F.explode(F.array("from_id", "to_id")).alias("end")).where("end IS NOT NULL")
    dangling = ends.join(objects.select(F.col("id").alias("end")), "end", "left_anti")
    return _union([
        _row(repeats(objects), "duplicate_node_id", "BLOCKING", object_id="id", detail=F.col("count").cast("string")),
        _row(repeats(links), "duplicate_edge_id", "BLOCKING", edge_id="id", detail=F.col("count").cast("string")),
        _issues(objects, about_objects, object_id="id"),
        _issues(links, about_links, edge_id="id"),
        _row(dangling, "dangling_edge_endpoint", "ERROR", edge_id="id", detail=F.col("end")),
        _row(orphans(objects, links), "orphan_object", "WARNING", object_id="id", detail=F.col("type")),
    ])


def _pairs(rules: dict[str, list[str]], key: str, value: str, spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in rules.items() for b in bs], f"{key} string, {value} string")


def orphans(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(id, type) of objects that no CONTAINS link of an expected parent type leads to."""
    types = objects.select(F.col("id").alias("from_id"), F.col("type").alias("parent_type"))
    held = links.where("type = 'CONTAINS'").join(types, "from_id").select(F.col("to_id").alias("id"), "parent_type").distinct()
    expected = _pairs(HELD_BY, "type", "parent_type", objects.sparkSession)
    wanted = objects.select("id", "type").join(expected.select("type").distinct(), "type", "left_semi")
    fine = wanted.join(held, "id").join(expected, ["type", "parent_type"], "left_semi").select("id")
    return wanted.join(fine, "id", "left_anti").select("id", "type")


def reference_rules(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Models, reports and parents that objects name and that are absent or of another type; links between wrong types."""
    types = objects.where("id IS NOT NULL").groupBy(F.col("id").alias("target")).agg(F.min("type").alias("target_type"))

    def named(column: str, kinds: list[str], wanted: str | None, code: str) -> DataFrame:
        own = objects.where(F.col("type").isin(kinds) & F.col(column).isNotNull()).select("id", F.col(column).alias("target"))
        told = own.join(types, "target", "left")
        lost = _row(told.where("target_type IS NULL"), f"missing_{code}_reference", "ERROR", object_id="id", detail=F.col("target"))
        if wanted is None:
            return lost
        return lost.unionByName(_row(told.where(F.col("target_type") != wanted), f"invalid_{code}_reference", "ERROR", object_id="id", detail=F.col("target")))

    ends = links.join(types.withColumnsRenamed({"target": "from_id", "target_type": "source_type"}), "from_id").join(types.withColumnsRenamed({"target": "to_id"}), "to_id")
    allowed = _pairs(HOLDS, "source_type", "target_type", objects.sparkSession)
    wrong = ends.where((F.col("type") == "CONTAINS") & F.col("source_type").isin(*HOLDS)).join(allowed, ["source_type", "target_type"], "left_anti")
    pair_rules = [
        ("invalid_model_binding", "ERROR", (F.col("type") == "USES_MODEL") & ~((F.col("source_type") == "REPORT") & (F.col("target_type") == "MODEL"))),
        ("invalid_visual_binding", "ERROR", (F.col("type") == "USES") & (F.col("source_type") == "VISUAL") & ~F.col("target_type").isin(FIELDS)),
        ("invalid_filter_binding", "ERROR", (F.col("type") == "FILTERS") & ~F.col("source_type").isin(FILTERS)),
        ("invalid_relationship_edge", "ERROR", (F.col("type") == "RELATES_TO") & (F.col("source_type") != "RELATIONSHIP") & (F.col("target_type") != "RELATIONSHIP")),
    ]
    return _union([
        named("model_id", MODEL_OBJECTS, "MODEL", "model"),
        named("report_id", REPORT_OBJECTS, "REPORT", "report"),
        named("parent_id", REPORT_OBJECTS, None, "parent"),
        _row(wrong, "invalid_containment", "ERROR", edge_id="id", detail=F.concat_ws(">", "source_type", "target_type")),
        _issues(ends, pair_rules, edge_id="id"),
    ])


def dependency_rules(objects: DataFrame, links: DataFrame) -> DataFrame:
    """DEPENDS_ON links with an absent end or a source that holds no expression, and cycles of CONTAINS and of DEPENDS_ON."""
    types = objects.where("id IS NOT NULL").groupBy("id").agg(F.min("type").alias("kind"))
    own = links.where("type = 'DEPENDS_ON'")
    told = own.join(types.toDF("from_id", "source_type"), "from_id", "left").join(types.toDF("to_id", "target_type"), "to_id", "left")
    broken = F.col("source_type").isNull() | F.col("target_type").isNull()
    rules = [("broken_dax_dependency", "ERROR", broken), ("invalid_dax_dependency_source", "ERROR", ~broken & ~F.col("source_type").isin(EXPRESSIONS))]
    loops = lambda kind: strong_components(links.where(F.col("type") == kind).dropna(subset=["from_id", "to_id"]))
    return _union([
        _issues(told, rules, edge_id="id"),
        _row(loops("DEPENDS_ON"), "dax_dependency_cycle", "BLOCKING", object_id="id", detail=F.col("cycle")),
        _row(loops("CONTAINS"), "containment_cycle", "BLOCKING", object_id="id", detail=F.col("cycle")),
    ])


def disappeared(before: DataFrame, links_before: DataFrame, after: DataFrame) -> DataFrame:
    """(object_id, source_id, dependents, examples): objects that are gone and what led to them before.

    ``examples`` are the five smallest dependents, so that a hub's row stays small; ``dependents`` counts all.
    """
    gone = before.join(after.select("id"), "id", "left_anti").select(F.col("id").alias("object_id"), "source_id")
    users = links_before.where("from_id IS NOT NULL").select(F.col("to_id").alias("object_id"), "from_id").distinct().join(gone.select("object_id"), "object_id", "left_semi")
    counts = users.groupBy("object_id").agg(F.count("*").alias("dependents"))
    few = smallest(users, "object_id", "from_id", 5)
    told = gone.join(counts, "object_id", "left").join(few, "object_id", "left")
    return told.select("object_id", "source_id", F.coalesce("dependents", F.lit(0)).alias("dependents"), F.coalesce("items", F.array().cast("array<string>")).alias("examples"))


def smallest(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, items): the ``most`` smallest values of each key; ranked first within salted parts, so no hub meets in one task whole."""
    from pyspark.sql import Window

    part = rows.select(key, value, F.pmod(F.xxhash64(value), F.lit(32)).alias("part"))
    ranked = part.withColumn("n", F.row_number().over(Window.partitionBy(key, "part").orderBy(value))).where(F.col("n") <= most)
    kept = ranked.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("n") <= most)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("items"))


# Links that tell meanings, and what decisions may not replace.
SEMANTIC_LINKS = ["CONTROLLED_BY", "HAS_OPTION", "DEFAULTS_TO", "SEMANTICALLY_MAPS_TO", "SIMILAR_TO", "CONFLICTS_WITH"]
IMMUTABLE = ["id", "type", "name", "model_id", "report_id", "source_id", "source", "evidence", "evidence_class", "from_id", "to_id", "status"]
DECISIONS = ["candidate", "approved", "rejected", "overridden"]


def semantic_rules(assertions: DataFrame, links: DataFrame) -> DataFrame:
    """Meanings that disagree, and links of meaning that pose as facts.

    ``assertions`` (target, assertion, value, status): several values among the approved are a contradiction, among the candidates
    an ambiguity. ``links`` as above.
    """
    own = assertions.where("value IS NOT NULL AND status IN ('approved', 'candidate')")
    several = own.groupBy("target", "assertion", "status").agg(F.countDistinct("value").alias("n")).where("n > 1")
    kind, status = F.coalesce("evidence_class", F.lit("FACT")), F.coalesce("status", F.lit("factual"))
    meaning = F.col("type").isin(SEMANTIC_LINKS)
    rules = [
        ("observed_evidence_mismatch", "ERROR", (F.col("type") == "OBSERVED_WITH") != (kind == "OBSERVED")),
        ("semantic_fact_mismatch", "ERROR", meaning & (F.col("type") != "HAS_OPTION") & (kind == "FACT")),
        ("semantic_status_mismatch", "ERROR", meaning & (kind == "INFERRED") & (status == "factual")),
    ]
    return _union([
        _row(several.where("status = 'approved'"), "approved_semantic_contradiction", "WARNING", object_id="target", detail=F.col("assertion")),
        _row(several.where("status = 'candidate'"), "candidate_semantic_ambiguity", "INFO", object_id="target", detail=F.col("assertion")),
        _issues(links, rules, edge_id="id"),
    ])


def selector_rules(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Options and defaults: their links must lead from a selector to an option, a default be one of the options, an option have an owner."""
    kinds = objects.select("id", "type")
    own = links.where("type IN ('HAS_OPTION', 'DEFAULTS_TO')").join(kinds.toDF("from_id", "source_type"), "from_id", "left").join(kinds.toDF("to_id", "target_type"), "to_id", "left")
    shaped = F.coalesce((F.col("source_type") == "SELECTOR") & (F.col("target_type") == "SELECTOR_OPTION"), F.lit(False))
    options = own.where(shaped & (F.col("type") == "HAS_OPTION")).select("from_id", "to_id").distinct()
    stray = own.where(shaped & (F.col("type") == "DEFAULTS_TO")).join(options, ["from_id", "to_id"], "left_anti")
    loose = objects.where("type = 'SELECTOR_OPTION'").join(options.select(F.col("to_id").alias("id")), "id", "left_anti")
    return _union([
        _row(own.where(~shaped), "invalid_selector_link", "ERROR", edge_id="id", detail=F.col("type")),
        _row(stray, "default_is_no_option", "ERROR", edge_id="id", detail=F.col("to_id")),
        _row(loose, "option_without_selector", "WARNING", object_id="id"),
    ])


def override_rules(overrides: DataFrame, targets: DataFrame) -> DataFrame:
    """Decisions (target, property, status) that name nothing, an unknown status or a generated field, stand twice, or whose target (id) is gone."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    named = overrides.where(~blank("target"))
    rules = [
        ("override_missing_property", "ERROR", blank("property")),
        ("override_invalid_status", "ERROR", ~F.lower(F.coalesce("status", F.lit("overridden"))).isin(DECISIONS)),
        ("override_mutates_generated_fact", "BLOCKING", F.lower("property").isin(IMMUTABLE)),
    ]
    twice = named.groupBy("target", "property").count().where("count > 1")
    stale = named.select("target").distinct().join(targets.select(F.col("id").alias("target")), "target", "left_anti")
    return _union([
        _row(overrides.where(blank("target")), "override_missing_target", "ERROR"),
        _issues(named, rules, object_id="target"),
        _row(twice, "duplicate_override", "WARNING", object_id="target", detail=F.col("property")),
        _row(stale, "stale_override", "WARNING", object_id="target"),
    ])
