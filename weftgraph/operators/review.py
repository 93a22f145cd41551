"""The queue of suggestions that a person decides on, and the concepts that suggestions agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.inference import slug

#: Types of which a wrong suggestion costs much. Fixed values.
WEIGHTY = ["MEASURE", "TABLE", "MODEL"]


def impact_class(kind: Column, target_type: Column, confidence: Column) -> Column:
    """High for conflicts, for suggestions on measures, tables and models, and for weak ones; else normal."""
    high = F.upper(kind).isin("CONFLICT", "CONFLICTS_WITH") | F.upper(target_type).isin(WEIGHTY) | (F.coalesce(confidence, F.lit(0.0)) < 0.5)
    return F.when(F.coalesce(high, F.lit(False)), "high").otherwise("normal")


def queue(objects: DataFrame, links: DataFrame, overrides: DataFrame) -> DataFrame:
    """(item_id, issue, type, target_id, model_id, confidence, impact): what waits for a decision.

    Objects whose status is ``candidate``; links that are inferred or conflicts and still candidates, unless an object with their
    ``candidate_key`` is in the queue already; decisions whose target is gone. ``objects`` (id, type, model_id, status, confidence,
    candidate_key), ``links`` (id, type, from_id, status, evidence_class, confidence, candidate_key), ``overrides`` (id, target).
    """
    nodes = objects.where("status = 'candidate'")
    seen = nodes.where("candidate_key IS NOT NULL").select("candidate_key").distinct()
    open_links = links.where("status = 'candidate' AND (evidence_class = 'INFERRED' OR type = 'CONFLICTS_WITH')").join(seen, "candidate_key", "left_anti")
    stale = overrides.join(objects.select(F.col("id").alias("target")), "target", "left_anti")
    row = lambda df, issue, kind, target, confidence: df.select(F.col("id").alias("item_id"), F.lit(issue).alias("issue"), kind.alias("type"), F.col(target).alias("target_id"), confidence.alias("confidence"))
    every = (
        row(nodes, "candidate", F.col("type"), "id", F.col("confidence"))
        .unionByName(row(open_links, "inferred_link", F.col("type"), "from_id", F.col("confidence")))
        .unionByName(row(stale, "stale_override", F.lit("OVERRIDE"), "target", F.lit(1.0)))
    )
    told = every.join(objects.select(F.col("id").alias("target_id"), F.col("type").alias("target_type"), "model_id"), "target_id", "left")
    return told.select("item_id", "issue", "type", "target_id", "model_id", "confidence", impact_class(F.col("type"), F.col("target_type"), F.col("confidence")).alias("impact"))


def filtered(rows: DataFrame, types: list[str] | None = None, models: list[str] | None = None, issues: list[str] | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    for column, values in (("type", types), ("model_id", models), ("issue", issues)):
        if values:
            rows = rows.where(F.col(column).isin(values))
    if least is not None:
        rows = rows.where(F.col("confidence") >= least)
    return rows if most is None else rows.where(F.col("confidence") <= most)


def concept_links(suggestions: DataFrame) -> DataFrame:
    """(from_id, to_id, type, confidence, suggestions) from objects to the one concept that each label stands for.

    ``suggestions`` (target, assertion, value, confidence); equal labels, but for case and outer blanks, share a concept, and of
    suggestions that say the same the surest counts.
    """
    label = F.lower(F.trim("value"))
    concept = F.concat(F.lit("concept:"), slug(F.col("value")), F.lit("-"), F.substring(F.sha2(label, 256), 1, 8))
    kind = F.when(F.col("assertion") == "ALIAS", "ALIAS_OF").otherwise("SEMANTICALLY_MAPS_TO")
    own = suggestions.where("value IS NOT NULL AND assertion IN ('BUSINESS_CONCEPT', 'ALIAS')")
    return own.groupBy(F.col("target").alias("from_id"), concept.alias("to_id"), kind.alias("type")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("suggestions"))
