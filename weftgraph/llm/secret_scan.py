"""Secret scan over a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: every match must hold
all trigrams of one alternative of each of its literal runs. The index lists, per trigram
that some query names, the documents that have it; postings meet per document, queries are
evaluated on them, and only candidates are verified with the pattern. The scan that makes the
postings writes along the texts that they can be asked for, so that no other text is read
again or shuffled: those that hold all trigrams of some query, or match a rule without
mandatory trigrams (the hex rule alone), which is tried on every text.

Spark has no function for the places of matches; they are the running sums of the lengths
of the parts that ``split`` leaves between them and of the matches themselves.

Defined cases: a null text counts as empty; a document without a secret has zero counts and
an empty list, whose digest is that of the empty string; rows that repeat id and text share
their spans and each get their row; a null id is a key like any other; an empty table gives
an empty result; further columns are ignored. Texts of one id are told apart by a 64-bit
hash and their length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.scratch import stage


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: the group whose length counts
    least: int = 0  #: shorter ones fail
    base: bool = False


#: The first three are fixed values, in the order in which kinds sort.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
)
#: Classes of so many letters, and runs of so many strings, are spelled out; wider ones count as unknown.
FEW_LETTERS, MOST_STRINGS = 8, 64


def _strings(items) -> tuple[list[frozenset[str]], frozenset[str] | None]:
    """Literal runs that each match of a parsed pattern must hold, and all its strings if they are few."""
    runs: list[frozenset[str]] = []
    now: frozenset[str] | None = frozenset([""])
    whole = True

    def cut():
        nonlocal now, whole
        if now and min(map(len, now)) >= 3:
            runs.append(now)
        now, whole = frozenset([""]), False

    for op, arg in items:
        name, inner, few = str(op), [], None
        if name == "LITERAL":
            few = frozenset([chr(arg).lower()])
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= FEW_LETTERS:
            few = frozenset(chr(c).lower() for _, c in arg)
        elif name == "SUBPATTERN":
            inner, few = _strings(arg[-1])
        elif name == "BRANCH":
            parts = [_strings(branch)[1] for branch in arg[1]]
            few = frozenset().union(*parts) if all(p is not None for p in parts) else None
        elif name == "MAX_REPEAT":
            least, most, body = arg
            inner, few = _strings(body)
            if (least, most) == (0, 1) and few is not None:
                few |= {""}
            elif few is not None and least == most and least <= 4:
                few = frozenset("".join(p) for p in product(few, repeat=least)) if len(few) ** least <= MOST_STRINGS else None
            else:
                few = None
            inner = inner if least else []
        if few is None or len(now) * len(few) > MOST_STRINGS:
            cut()
            runs += inner
            if few is not None:
                now = few
        else:
            now = frozenset(a + b for a in now for b in few)
    every = now if whole else None
    if not whole or runs:
        cut()
    return runs, every


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of ORs of ANDs of lower-case trigrams; empty if nothing is mandatory."""
    runs, every = _strings(re._parser.parse(pattern))
    if every is not None and min(map(len, every)) >= 3:
        runs = [every]
    out = []
    for run in runs:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        out.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))
    return out


def text_key(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.struct(F.xxhash64(text).alias("hash"), F.length(text).alias("points"))


def trigrams_of(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``docs`` with ``have``, the given trigrams that the lower-cased text holds."""
    low = docs.withColumn("low", F.lower("text"))
    has = F.array_compact(F.array(*[F.when(F.col("low").contains(t), t) for t in trigrams]))
    return low.withColumn("have", has).drop("low")


def fulfilled(query: list[list[frozenset[str]]], has) -> Column:
    """Whether ``query`` holds, where ``has`` tells if all of some trigrams are there."""
    every = F.lit(True)
    for run in query:
        some = F.lit(False)
        for need in run:
            some = some | has(sorted(need))
        every = every & some
    return every


def candidates(index: DataFrame, queries: dict[str, list[list[frozenset[str]]]]) -> DataFrame:
    """(id, h, kinds) of documents whose postings fulfil some query."""
    met = index.groupBy("id", "h").agg(F.collect_set("trigram").alias("have"))

    listed = lambda need: F.size(F.array_except(F.array(*map(F.lit, need)), "have")) == 0
    kinds = F.array_compact(F.array(*[F.when(fulfilled(q, listed), kind) for kind, q in queries.items()]))
    return met.select("id", "h", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _matches(rule: Rule) -> Column:
    """An array of (kind, gap before, match length, counted length) of the matches in ``text``."""
    pattern = f"(?:{rule.pattern})"
    return F.zip_with(
        F.slice(F.split("text", pattern, -1), 1, F.greatest(F.size(F.split("text", pattern, -1)) - 1, F.lit(0))),
        F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)).alias("b")),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["a"]).alias("size"), F.length(m["b"]).alias("counted")),
    )


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, h, kind, start, end), once for rows that repeat id and text; code points, end exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text_key(text).alias("h"), text.alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for run in q for need in run for t in need})
    scans = [r for r in rules if r.kind not in queries]
    hit = F.lit(False)
    for r in scans:
        hit = hit | F.col("text").rlike(r.pattern)
    likely = F.col("scanned")
    for q in queries.values():
        likely = likely | fulfilled(q, lambda need: F.size(F.array_except(F.array(*map(F.lit, need)), "have")) == 0)
    seen = trigrams_of(base, trigrams).withColumn("scanned", hit)
    seen = stage(seen.select("id", "h", "have", "scanned", F.when(likely, F.col("text")).alias("text")), "trigrams")
    index = seen.select(F.explode("have").alias("trigram"), "id", "h")
    wanted = candidates(index, queries).withColumnsRenamed({"id": "id2", "h": "h2"})
    texts = seen.where("text IS NOT NULL").select("id", "h", "text", "scanned")
    met = texts.join(wanted, texts["id"].eqNullSafe(wanted["id2"]) & (texts["h"] == wanted["h2"]), "left")
    read = met.where("scanned OR kinds IS NOT NULL").dropDuplicates(["id", "h"])
    found = []
    for r in rules:
        on = F.col("scanned") if r in scans else F.array_contains("kinds", r.kind)
        found.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), F.when(on, _matches(r)).alias("hits")))
    each = read.select("id", "h", F.explode(F.array(*found)).alias("r")).select("id", "h", "r.kind", "r.least", F.posexplode("r.hits").alias("n", "m"))
    so_far = Window.partitionBy("id", "h", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(so_far))
    return placed.where("m.counted >= least").select("id", "h", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = F.create_map(*[x for n, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(n))])
    base = [r.kind for r in RULES if r.base]
    spans = find_spans(docs).withColumn("place", order[F.col("kind")])
    listed = spans.groupBy(F.col("id").alias("id2"), F.col("h").alias("h2")).agg(F.array_sort(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("all"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>"))
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = docs.select(F.col("doc_id"), text_key(F.coalesce("text", F.lit(""))).alias("h"))
    return rows.join(listed, rows["doc_id"].eqNullSafe(listed["id2"]) & (rows["h"] == listed["h2"]), "left").select(
        "doc_id", *map(count, base), F.sha2(text(F.filter(every, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(every).alias("spans")
    )
