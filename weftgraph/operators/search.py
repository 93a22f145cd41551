"""Ranked search, pages, resolution, prefix search and BM25 over text columns.

Searchable fields are those columns of ``WEIGHTS`` that the objects have; an array holds several values.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import lexical
from weftgraph.functions.lineage import cut

#: Field weights and what weaker matches cost. Fixed values.
WEIGHTS = {
    "id": 1000, "source_id": 960, "name": 920, "raw_name": 890, "display_name": 880, "qualified_name": 870, "aliases": 850, "synonyms": 850,
    "raw_id": 830, "meaning": 760, "concept": 760, "description": 700, "raw_description": 680, "expression": 520, "formula": 520, "raw_expression": 510,
}
PREFIX, PHRASE, ALL_WORDS = 60, 90, 120
#: Of objects that share a name the first type is meant; others come last. Fixed values.
TYPE_RANK = {"MEASURE": 0, "COLUMN": 1, "TABLE": 2, "CALCULATION_ITEM": 3, "PAGE": 4, "VISUAL": 5}
LEAST_PAGE, MOST_PAGE = 1, 100
#: First words of names that are sent along with a plan.
MOST_FIRST_WORDS = 10_000


def words_of(query: str) -> list[str]:
    """The folded words of a query, as ``lexical`` makes those of a value."""
    return re.findall(r"\w+", query.lower())


def ladder(value: Column, query: str, weight: int) -> Column:
    """Score of one value: the same words, a prefix, a phrase, all words in any order, or null."""
    own = words_of(query)
    v, q = lexical(value), " ".join(own)
    words = F.array(*map(F.lit, sorted(set(own))))
    padded = F.concat(F.lit(" "), v, F.lit(" "))
    return (
        F.when(v == q, weight)
        .when(v.startswith(q), weight - PREFIX)
        .when(padded.contains(f" {q} "), weight - PHRASE)
        .when(F.size(F.array_except(words, F.split(v, " "))) == 0, weight - ALL_WORDS)
    )


def fields_of(nodes: DataFrame) -> list[str]:
    return [c for c in WEIGHTS if c in nodes.columns]


def matches(nodes: DataFrame, query: str, fields: list[str] | tuple[str, ...] | None = None) -> Column:
    """An array of (minus, field, value), best first, of the values that match; ``minus`` is the score negated."""
    kinds = dict(nodes.dtypes)

    def of(field: str) -> Column:
        values = F.col(field) if kinds[field].startswith("array") else F.array(F.col(field))
        score = lambda v: F.when(F.lit(field == "id") & (v == query), WEIGHTS[field]).otherwise(ladder(v, query, WEIGHTS[field]))
        found = F.transform(values, lambda v: F.struct((-score(v)).alias("minus"), F.lit(field).alias("field"), v.alias("value")))
        return F.filter(F.coalesce(found, F.array().cast("array<struct<minus:int,field:string,value:string>>")), lambda m: m["minus"].isNotNull())

    return F.array_sort(F.concat(*[of(f) for f in fields or fields_of(nodes)]))


def ranked(nodes: DataFrame, query: str, fields: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """(id, type, name, score) of matches; order by score down, type, folded name, model, report, id."""
    rows = nodes.withColumn("hits", matches(nodes, query, fields)).where("size(hits) > 0")
    rest = [F.col(c).asc_nulls_first() for c in ("model_id", "report_id") if c in nodes.columns]
    ordered = rows.withColumn("score", -F.col("hits")[0]["minus"]).orderBy(F.desc("score"), "type", lexical(F.col("name")), *rest, "id")
    return ordered.select("id", "type", "name", "score")


def holding(nodes: DataFrame, query: str) -> DataFrame:
    """(id, type, name, score) of objects whose name, description or id holds the query anywhere, in order of id; the score is 0."""
    hit = F.lit(False)
    for c in ("name", "description", "id"):
        if c in nodes.columns:
            hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return nodes.where(hit).select("id", "type", "name", F.lit(0).alias("score")).orderBy("id")


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One exact page of ordered ``rows``, each with total, has_more and next_offset (null on the last page).

    ``rows`` must end their order with a key. The total is one number.
    """
    if not LEAST_PAGE <= limit <= MOST_PAGE or offset < 0:
        raise ValueError(f"limit must be {LEAST_PAGE} to {MOST_PAGE} and offset at least 0")
    total = rows.count()
    after = offset + limit
    more = after < total
    told = {"total": F.lit(total).cast("long"), "has_more": F.lit(more), "next_offset": F.lit(after if more else None).cast("long")}
    return rows.offset(offset).limit(limit).withColumns(told)


def page_within(rows: DataFrame, size: Column, budget: int, limit: int, offset: int = 0, order: list[str] | None = None) -> DataFrame:
    """A page of ``rows`` (ordered by ``order``, which ends in a key) as far as the sizes of its rows stay within ``budget``.

    Each row tells total, has_more and next_offset; the next page goes on where this one was cut. A first row that alone is
    over the budget is not shown, and the next offset stays.
    """
    whole = page(rows.orderBy(*order) if order else rows, limit, offset)
    so_far = F.sum("size").over(Window.orderBy(*(order or whole.columns[:1])).rowsBetween(Window.unboundedPreceding, 0))  # over one page
    kept = whole.withColumn("size", size).withColumn("so_far", so_far).where(F.col("so_far") <= budget).drop("size", "so_far")
    shown = kept.count()
    more = F.col("total") > offset + shown
    return kept.withColumns({"has_more": more, "next_offset": F.when(more, F.lit(offset + shown).cast("long"))})


def answer(nodes: DataFrame, query: str, limit: int, offset: int = 0, types: list[str] | None = None, models: list[str] | None = None, reports: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """A page of what a search finds in a scope; where nothing matches by words, of what holds the query anywhere."""
    own = scope(nodes, types, models, reports, statuses)
    hits = ranked(own, query)
    return page(hits if not hits.isEmpty() else holding(own, query), limit, offset)


def ambiguity(hits: DataFrame, query: str) -> DataFrame:
    """(id, reason) of the candidates of an ambiguous query, from its ``hits`` (id, name, score); no row if it is clear.

    Several objects of exactly that name, else several at the top score.
    """
    top = hits.agg(F.max("score").alias("top"), F.count_if(lexical(F.col("name")) == " ".join(words_of(query))).alias("named")).first()
    if (top["named"] or 0) > 1:
        some, reason = hits.where(lexical(F.col("name")) == " ".join(words_of(query))), "duplicate_exact_name_across_scopes"
    else:
        some, reason = hits.where(F.col("score") == F.lit(top["top"])), "multiple_top_matches"
    told = some.select("id", F.lit(reason).alias("reason"))
    return told if (top["named"] or 0) > 1 or some.limit(2).count() > 1 else told.limit(0)


def prefix_search(docs: DataFrame, query: str, id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the texts in which every word of the query begins some word; BM25 over those words, no stemming.

    Words are counted by pattern where the text lies; only counts are gathered. A word that begins words of half the
    texts or more weighs next to nothing.
    """
    terms = words_of(query)
    low = lexical(F.coalesce(F.col(text_col), F.lit("")))
    times = [F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(t)}")).alias(f"n{i}") for i, t in enumerate(terms)]
    sized = docs.select(F.col(id_col).alias("id"), F.when(low == "", 0).otherwise(F.regexp_count(low, F.lit(" ")) + 1).alias("size"), *times)
    told = sized.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(terms)):
        n = F.col(f"n{i}")
        idf = max(math.log((told["docs"] - told[f"d{i}"] + 0.5) / (told[f"d{i}"] + 0.5)), 1e-6)
        score = score + F.lit(idf) * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("size") / F.lit(told["mean"] or 1.0)))
        every = every & (n > 0)
    return sized.where(every).select("id", F.round(score, 6).alias("score"))


def bm25(docs: DataFrame, terms: list[str], id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with a term, prefix matches not counted."""
    low = lexical(F.coalesce(F.col(text_col), F.lit("")))
    times = lambda term: F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(term)}(?![\p{{L}}\p{{N}}_])"))
    size = F.when(low == "", 0).otherwise(F.regexp_count(low, F.lit(" ")) + 1)
    sized = docs.select(F.col(id_col).alias("id"), size.alias("size"), *[times(t).alias(f"n{i}") for i, t in enumerate(terms)])
    total = sized.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), *[F.sum((F.col(f"n{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.lit(total["docs"]) - (total[f"d{i}"] or 0) + 0.5) / ((total[f"d{i}"] or 0) + 0.5))
        n = F.col(f"n{i}")
        score = score + idf * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("size") / F.lit(total["mean"])))
    return sized.where(" or ".join(f"n{i} > 0" for i in range(len(terms)))).select("id", F.round(score, 6).alias("score"))


def excerpt(text: Column, query: str, length: int = 240) -> Column:
    """At most ``length`` characters of the text, a third of them before the query's first place; marks show what is cut off."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    wanted = F.greatest(F.instr(F.lower(flat), query.lower()) - 1 - length // 3, F.lit(0))
    start = F.greatest(F.least(wanted, F.length(flat) - length), F.lit(0))
    some = F.substring(flat, start + 1, F.lit(length))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), some, F.when(start + length < F.length(flat), "…").otherwise(""))
    return F.when(F.length(flat) <= length, flat).otherwise(cut)


def scope(nodes: DataFrame, types: list[str] | None = None, models: list[str] | None = None, reports: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Nodes of the types, models, reports and statuses named; a model's or report's own id counts as its own."""
    owner = lambda kind, column: F.when(F.col("type") == kind, F.col("id")).otherwise(F.col(column))
    kept = nodes
    if types:
        kept = kept.where(F.col("type").isin(types))
    if models:
        kept = kept.where(owner("MODEL", "model_id").isin(models))
    if reports:
        kept = kept.where(owner("REPORT", "report_id").isin(reports))
    return kept.where(F.col("status").isin(statuses)) if statuses else kept


def evidence(nodes: DataFrame, query: str, fields: list[str] | tuple[str, ...] | None = None, most: int = 3) -> DataFrame:
    """(id, score, evidence): per match the best fields, by score down, field and value."""
    rows = nodes.select("id", F.slice(matches(nodes, query, fields), 1, most).alias("evidence")).where("size(evidence) > 0")
    return rows.select("id", (-F.col("evidence")[0]["minus"]).alias("score"), "evidence")


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, candidates, id): an exact id, else the one node of that source id or name; never a part of a name."""
    by_id = nodes.select(F.col("id").alias("wanted"), F.col("id").alias("exact")).dropDuplicates(["wanted"])
    told = [F.struct(lexical(F.col("name")).alias("k"))] + ([F.struct(lexical(F.col("source_id")).alias("k"))] if "source_id" in nodes.columns else [])
    keys = nodes.select("id", F.explode(F.array(*told)).alias("t")).select("id", "t.k").where("k <> ''").distinct()
    by_name = keys.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("named"))
    rows = names.select("wanted", lexical(F.col("wanted")).alias("k")).join(by_id, "wanted", "left").join(by_name, "k", "left")
    return rows.select("wanted", F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("candidates"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("named"))).alias("id"))


def resolve_references(objects: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, status, id, candidates) of names like ``Table[Column]``, ``[Name]``, a plain name or an id.

    An exact id stands. Else objects of that folded name count, those of the table first if one is named and has any;
    among them the first type by rank. One of that type is FOUND, several are AMBIGUOUS (``id`` is the smallest).
    """
    blank = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    asked = names.select("wanted", F.trim("wanted").alias("w")).distinct()
    inner = F.regexp_extract("w", r"\[([^\[\]]+)\]$", 1)
    owner = F.regexp_replace(F.trim(F.regexp_extract("w", r"^([^\[\]]*)\[", 1)), "^'|'$", "")
    parts = asked.withColumn("key", blank(F.when(inner != "", inner).otherwise(F.col("w")))).withColumn("home", F.when(owner != "", blank(owner)))
    tables = objects.where("type = 'TABLE'").select(F.col("id").alias("parent_id"), blank(F.col("name")).alias("table_key"))
    known = objects.select("id", "type", "parent_id", blank(F.col("name")).alias("key")).join(tables, "parent_id", "left")
    rank = F.coalesce(*[F.when(F.col("type") == t, n) for t, n in TYPE_RANK.items()], F.lit(9))
    own = F.coalesce(F.col("table_key") == F.col("home"), F.lit(False))
    met = parts.join(known, "key").groupBy("wanted", own.alias("own"), rank.alias("rank")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    best = met.groupBy("wanted").agg(F.min(F.struct((~F.col("own")).alias("other"), "rank", "n", "id")).alias("b"))
    exact = objects.select(F.col("id").alias("w"), F.lit(True).alias("exact")).dropDuplicates(["w"])
    rows = parts.join(exact, "w", "left").join(best, "wanted", "left")
    status = F.when(F.col("exact") | (F.col("b.n") == 1), "FOUND").when(F.col("b.n") > 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    return rows.select("wanted", status.alias("status"), F.when(F.col("exact"), F.col("w")).otherwise(F.col("b.id")).alias("id"), F.when(F.col("exact"), 1).otherwise(F.coalesce("b.n", F.lit(0))).cast("long").alias("candidates"))


def mentions(docs: DataFrame, names: DataFrame, id_col: str, text_col: str, longest: int = 8, overlapping: bool = False) -> DataFrame:
    """(id, names): names that a text mentions, from its start on the longest first, each name once, none overlapping unless ``overlapping``.

    ``names`` has a ``name`` column; names of over ``longest`` words, or under three characters, are not
    looked for, and one plain word counts only where it is capitalised. Texts without a mention have no row. A place is
    left before any phrase is formed if no name begins with its word, and phrases have only the lengths of such names. Up to
    ``MOST_FIRST_WORDS`` first words go with the plan, more are joined.
    """
    clean = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    known = names.select(F.lower(F.array_join(clean(F.col("name")), " ")).alias("phrase")).where("length(phrase) >= 3").distinct()
    known = cut(known.withColumns({"words": F.split("phrase", " "), "first": F.split("phrase", " ")[0]}).select("phrase", "first", F.size("words").alias("n")).where(F.col("n") <= longest))
    sizes = range(1, longest + 1)
    firsts = cut(known.groupBy("first").agg(*[F.max(F.col("n") == n).alias(f"n{n}") for n in sizes]))
    any_of = firsts.agg(*[F.max(f"n{n}").alias(f"n{n}") for n in sizes]).first()
    lengths = [n for n in sizes if any_of[f"n{n}"]]
    few = [r["first"] for r in firsts.select("first").limit(MOST_FIRST_WORDS + 1).collect()]
    words = docs.select(F.col(id_col).alias("id"), clean(F.col(text_col)).alias("w")).where("size(w) > 0")
    # a row per place holds its next words alone, never the whole text
    places = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("pos"), F.slice("w", i + 1, max(lengths, default=1)).alias("next")))
    if len(few) <= MOST_FIRST_WORDS:
        begins = F.filter(F.transform("w", lambda w, i: F.struct(F.lower(w).alias("v"), i.alias("i"))), lambda x: x["v"].isin(few))
        places = F.transform(begins, lambda x: F.struct(x["i"].alias("pos"), F.slice("w", x["i"] + 1, max(lengths, default=1)).alias("next")))
    at = words.select("id", F.explode(places).alias("p")).select("id", "p.pos", "p.next", F.lower(F.col("p.next")[0]).alias("first")).join(firsts, "first")
    piece = lambda n: F.struct(F.lit(n).alias("len"), F.lower(F.array_join(F.slice("next", 1, n), " ")).alias("phrase"))
    able = lambda n: F.col(f"n{n}") & (F.size("next") >= n) & (F.lit(n > 1) | F.col("next")[0].rlike(r"^\p{Lu}"))
    pieces = F.array_compact(F.array(*[F.when(able(n), piece(n)) for n in lengths])) if lengths else F.array().cast("array<struct<len:int,phrase:string>>")
    grams = at.select("id", "pos", F.explode(pieces).alias("g")).select("id", "pos", "g.*")
    found = grams.join(known.select("phrase"), "phrase")
    if overlapping:
        first = found.groupBy("id", "phrase").agg(F.min("pos").alias("pos"), F.first("len").alias("len"))
        told = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("len")).alias("minus"), "phrase"))).alias("hits"))
        return told.select("id", F.transform("hits", lambda h: h["phrase"]).alias("names"))
    hits = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("len")).alias("minus"), "phrase"))).alias("hits"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("names"))
    take = lambda s, h: F.when((h["pos"] >= s["next"]) & ~F.array_contains(s["names"], h["phrase"]), F.struct((h["pos"] - h["minus"]).alias("next"), F.array_append(s["names"], h["phrase"]).alias("names"))).otherwise(s)
    return hits.select("id", F.aggregate("hits", start, take, lambda s: s["names"]).alias("names"))
