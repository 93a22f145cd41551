"""Scored facts about objects: evidence, roles, denials, selectors, options, shared concepts, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import alnum_key, noisy_or

#: What one piece of evidence weighs, by where it comes from; anything else weighs UNKNOWN. Fixed values.
WEIGHTS = {
    "description": 0.96, "model_metadata": 0.82, "structural": 0.82, "dax_ast": 0.86, "dax_analysis": 0.86, "report_usage": 0.48,
    "report_metadata": 0.42, "object_name": 0.30, "name": 0.30, "manual": 1.0, "llm": 0.20,
}
UNKNOWN = 0.15
#: The first role with a word in the text. Fixed values.
ROLES = {
    "date_dimension": ["date", "calendar", "time", "period"],
    "customer_dimension": ["customer", "client", "account"],
    "product_dimension": ["product", "item", "sku"],
    "fact": ["fact", "transaction", "invoice", "sales", "orders", "order"],
    "selector": ["selector", "switch", "parameter", "choice", "option"],
}
#: Words by which a text denies a behaviour up to five words on. Fixed values.
DENIALS = ["not", "never", "without", "no", "does not", "doesn't", "isn't", "is not"]


def evidence_weight(source: Column) -> Column:
    """Weight of one source; the longest name that it holds decides, of equally long ones the first in ``WEIGHTS``."""
    out, s = F.lit(UNKNOWN), F.lower(F.coalesce(source, F.lit("")))
    for key in sorted(reversed(WEIGHTS), key=len):
        out = F.when(s.contains(key), WEIGHTS[key]).otherwise(out)
    return out


def confidence(evidence: DataFrame, key: str, source: str) -> DataFrame:
    """(key, sources, confidence): noisy-or over the distinct sources of a key."""
    own = evidence.groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce(source, F.lit("")))).alias("sources"))
    return own.withColumn("confidence", noisy_or(F.transform("sources", lambda s: evidence_weight(s))))


def role_from_text(c: Column) -> Column:
    words, out = F.split(F.lower(c), "[^a-z0-9]+"), F.lit(None).cast("string")
    for role, names in reversed(ROLES.items()):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, names))), role).otherwise(out)
    return out


def denies(c: Column, aliases: list[str], reach: int = 5) -> Column:
    """Whether one of ``aliases`` follows a denial with at most ``reach`` words between.

    Texts are read as words, so letters that only look like a denial inside a word are none; an alias may
    have several words. A null text denies nothing.
    """
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_']+"), lambda w: w != "")
    plain = [w for w in DENIALS if " " not in w]  # of two words the last, "not", tells

    def follows(at: Column) -> Column:
        found = F.lit(False)
        for alias in aliases:
            own = alias.lower().split()
            near = F.concat(F.lit(" "), F.array_join(F.slice(words, at + 2, reach + len(own)), " "), F.lit(" "))
            found = found | near.contains(f" {' '.join(own)} ")
        return F.get(words, at).isin(plain) & found

    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.coalesce(F.exists(places, follows), F.lit(False))


def scored(objects: DataFrame, facts: dict[str, tuple[DataFrame, float]], cap: float = 0.99) -> DataFrame:
    """(id, facts, score): sums of the weights of the facts whose ``id`` rows name the object, at most ``cap``.

    All facts are gathered by one shuffle on id, however many there are.
    """
    rows = None
    for name, (ids, weight) in facts.items():
        one = ids.select("id", F.lit(name).alias("fact"), F.lit(weight).alias("weight"))
        rows = one if rows is None else rows.union(one)
    told = rows.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("fact", "weight"))).alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x["weight"])
    return objects.select("id").join(told, "id", "left").select("id", F.coalesce(F.transform("f", lambda x: x["fact"]), F.array().cast("array<string>")).alias("facts"), F.round(F.least(F.coalesce(total, F.lit(0.0)), F.lit(cap)), 6).alias("score"))


def options(rows: DataFrame, owner: str, value: str, most: int = 100) -> DataFrame:
    """(owner, ordinal, value): the sorted distinct values of owners with at most ``most``; others have none."""
    pairs = rows.select(owner, value).dropna().distinct()
    few = pairs.groupBy(owner).count().where(F.col("count") <= most).select(owner)
    return pairs.join(few, owner, "left_semi").withColumn("ordinal", F.row_number().over(Window.partitionBy(owner).orderBy(value)))


def concepts(rows: DataFrame, label: Column) -> DataFrame:
    """(concept_id, members, sources): equal labels, but for case and outer blanks, share one node."""
    slug = F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), F.lit("-"))
    key = F.concat(F.lit("concept:"), slug, F.lit("-"), F.substring(F.sha2(F.lower(F.trim(label)), 256), 1, 8))
    return rows.groupBy(key.alias("concept_id")).agg(F.count("*").alias("members"), F.countDistinct("source").alias("sources")).dropna(subset=["concept_id"])


def low_evidence(name: Column, value: Column, source: Column, evidence: Column, score: Column, kind: Column | None = None) -> Column:
    """Whether a suggestion says little: it restates the name, or nothing but the name stands behind it, or it scores at most 35 %.

    A score counts only where no evidence besides the name is given; one over 1 is in percent already. Conflicts and
    stale items (``kind``) never count as low.
    """
    names = ["object_name", "name"]
    sources = F.transform(F.coalesce(evidence, F.array().cast("array<string>")), lambda e: F.lower(e))
    from_names = F.size(F.filter(sources, lambda e: e.isin(names)))
    others = F.size(sources) - from_names
    key = alnum_key(name)
    restates = F.coalesce((key != "") & (key == alnum_key(value)), F.lit(False))
    told_by_name = F.coalesce(F.lower(source).isin(names), F.lit(False)) & (F.size(sources) < 2)
    percent = F.when(score > 1, score).otherwise(100 * score)
    poor = F.coalesce(F.bround(percent) <= 35, F.lit(False))
    low = restates | told_by_name | ((others == 0) & ((from_names > 0) | poor))
    return low if kind is None else low & ~F.coalesce(kind.isin("conflict", "stale"), F.lit(False))


def auto_accepted(source: Column, confidence: Column, reopened: Column, threshold: float = 0.9) -> Column:
    return F.coalesce(source.isin("object_name", "description") & (confidence >= threshold) & ~F.coalesce(reopened, F.lit(False)), F.lit(False))


def decide(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """``items`` (id, status) with the status that ``decisions`` (id, status), one per id, give them; ``previous`` holds the old one."""
    new = decisions.select("id", F.col("status").alias("__new"))
    return items.join(new, "id", "left").withColumn("previous", F.when(F.col("__new").isNotNull(), F.col("status"))).withColumn("status", F.coalesce("__new", "status")).drop("__new")


def undo(items: DataFrame) -> DataFrame:
    """Exactly what stood before ``decide``."""
    return items.withColumn("status", F.coalesce("previous", "status")).drop("previous")


def overlay(rows: DataFrame, overrides: DataFrame, properties: list[str]) -> DataFrame:
    """``rows`` (id, ...) with the values that ``overrides`` (id, property, value) set; a property without one stays.

    Of several values for one property the largest stands, so that the result does not hang on row order.
    """
    wide = overrides.groupBy("id").agg(*[F.max(F.when(F.col("property") == p, F.col("value"))).alias(f"__{p}") for p in properties])
    joined = rows.join(wide, "id", "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in properties else F.col(c) for c in rows.columns])


def carry_over(new: DataFrame, old: DataFrame, default: str = "FACT") -> DataFrame:
    """``new`` (id, status) with the earlier status where that was not the default."""
    kept = old.where(F.col("status") != default).select("id", F.col("status").alias("__old"))
    return new.join(kept, "id", "left").withColumn("status", F.coalesce("__old", "status")).drop("__old")


#: Objects that may mean something, names that say nothing, and what a description declares. Fixed values.
MEANINGFUL = ["MODEL", "TABLE", "COLUMN", "MEASURE", "FIELD_PARAMETER", "SHARED_EXPRESSION", "USER_DEFINED_FUNCTION", "CALCULATION_GROUP", "CALCULATION_ITEM"]
GENERIC = ["column", "columns", "field", "fields", "measure", "measures", "model", "table", "value", "values", "name", "id", "object"]
DECLARED = {
    "fact": ["fact", "transaction", "invoice", "sales", "orders", "order"],
    "dimension": ["dimension", "calendar", "date", "customer", "product"],
    "selector": ["selector", "switch", "parameter", "choice", "option", "options"],
    "measure": ["measure", "metric", "calculation", "calculated"],
}
#: Words that name a behaviour in a denial. Fixed values.
BEHAVIOUR_WORDS = {
    "selector": ["selector", "switch", "parameter", "selected value"],
    "filter_context": ["filter", "filtered", "filter context"],
    "relationship": ["relationship", "relation"],
    "formatting": ["format", "formatted", "formatting"],
    "conditional": ["condition", "conditional", "branch"],
    "function": ["function", "call"],
}


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def candidates(objects: DataFrame) -> DataFrame:
    """(target, assertion, value, source, priority) of what objects (id, type, name, description, functions) may mean.

    A description is the meaning, with the name as alias where it says something else, and the role that its words declare.
    Only without one does the name count, unless it is generic or a number. Called functions are behaviours. All from one scan.
    """
    text, name = F.trim("description"), F.trim("name")
    described = F.coalesce(text != "", F.lit(False))
    said = F.coalesce(name != "", F.lit(False)) & ~slug(name).isin(GENERIC)
    numbered = F.lower(name).rlike(r"^(?:table|column|measure)[ _-]?\d+$")
    one = lambda when, assertion, value, source, priority: F.when(
        F.coalesce(when, F.lit(False)), F.struct(F.lit(assertion).alias("assertion"), value.alias("value"), F.lit(source).alias("source"), F.lit(priority).alias("priority"))
    )
    own = F.array_compact(F.array(
        one(described, "BUSINESS_CONCEPT", text, "description", 1),
        one(described & said & (slug(name) != slug(text)), "ALIAS", name, "description", 1),
        one(described & role_from_text(text).isNotNull(), "ROLE", role_from_text(text), "description", 1),
        one(~described & said & ~numbered, "BUSINESS_CONCEPT", name, "object_name", 5),
    ))
    called = F.coalesce(F.array_distinct(F.transform("functions", lambda f: F.upper(f))), F.array().cast("array<string>"))
    acts = F.transform(called, lambda f: F.struct(F.lit("BEHAVIOR").alias("assertion"), f.alias("value"), F.lit("dax_analysis").alias("source"), F.lit(2).alias("priority")))
    meant = F.when(F.col("type").isin(MEANINGFUL), own).otherwise(F.slice(own, 1, 0))
    return objects.select(F.col("id").alias("target"), F.explode(F.concat(meant, acts)).alias("c")).select("target", "c.*")


def conflicts(objects: DataFrame, behaviours: DataFrame) -> DataFrame:
    """(target, behaviour, reason) where a description contradicts what an object does; the smallest behaviour tells.

    ``objects`` (id, description), ``behaviours`` (id, behaviour), roles as in ``FUNCTION_CLASSES``. A fact or dimension that
    acts as a selector is one; so is a description that denies the behaviour. Silence contradicts nothing.
    """
    words = F.split(F.lower("description"), r"[^\p{L}\p{N}]+")
    declared = F.arrays_overlap(words, F.array(*map(F.lit, DECLARED["fact"] + DECLARED["dimension"])))
    denied = F.array_compact(F.array(*[F.when(denies(F.col("description"), aliases), role) for role, aliases in BEHAVIOUR_WORDS.items()]))
    told = objects.where("description IS NOT NULL").select("id", declared.alias("declared"), denied.alias("denied")).join(behaviours.distinct(), "id")
    reason = F.when(F.col("declared") & (F.col("behaviour") == "selector"), "declared_role").when(F.array_contains("denied", F.col("behaviour")), "denied")
    return told.withColumn("reason", reason).where("reason IS NOT NULL").groupBy(F.col("id").alias("target")).agg(F.min(F.struct("behaviour", "reason")).alias("r")).select("target", "r.*")


def selected_defaults(formulas: DataFrame) -> DataFrame:
    """(id, column, fallback) of SELECTEDVALUE calls with a constant alternate in formulas (id, formula)."""
    from weftgraph.functions.expressions import REFERENCE, STRING

    call = rf"(?i:SELECTEDVALUE)\s*\(\s*({REFERENCE})\s*,\s*({STRING}|-?\d+(?:\.\d+)?)\s*\)"
    pairs = F.arrays_zip(F.regexp_extract_all("formula", F.lit(call), F.lit(1)).alias("c"), F.regexp_extract_all("formula", F.lit(call), F.lit(2)).alias("v"))
    return formulas.select("id", F.explode(pairs).alias("p")).select("id", F.col("p.c").alias("column"), F.regexp_replace("p.v", '^"|"$', "").alias("fallback")).distinct()
