"""A stored inverted index: built once, told of changes per document, and read by term.

Postings lie in Parquet, parted by a hash of a term's first two letters and sorted by term, so that a search reads only
the parts and row groups of the terms it names, by equality or by prefix range. A row is one term in one block of
documents: its entries, and beside them the most often and the shortest, which bound the score of any entry without
reading it. Blocks are the same for all terms: documents of like length and hash.

Each build or change is a segment. A change writes the postings of its documents and names the older versions that they
replace; searches leave those out. The row of totals is written last, and a segment without one is not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import lexical
from weftgraph.functions.lineage import cut
from weftgraph.functions.stems import stem
from weftgraph.operators.search import words_of

PARTS = 32
#: Documents of one block, about.
BLOCK = 1024
#: Shuffle partitions for each slice of a part; slices are of blocks, so that a frequent term is no single task's.
SLICE = 8
#: Blocks whose scores set the first floor of a search for the best.
FIRST_BLOCKS = 4
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    path: str
    stemmed: bool
    docs: int
    words: int
    segments: list[int]

    @property
    def mean(self) -> float:
        return self.words / self.docs if self.docs and self.words else 1.0


def _terms(text: Column, stemmed: bool) -> Column:
    words = F.filter(F.split(lexical(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    return F.transform(words, stem) if stemmed else words


def _head(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(PARTS)).cast("int")


def _write(docs: DataFrame, index: Index, number: int, id_col: str, text_col: str) -> DataFrame:
    """Writes the postings and documents of one segment and returns the latter."""
    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / BLOCK)))
    named = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _terms(F.col(text_col), index.stemmed).alias("terms"))
    sized = named.withColumn("size", F.size("terms")).withColumn("block", F.shiftleft(F.ceil(F.log2(F.col("size") + F.lit(1.0))).cast("long"), 40) + (F.shiftrightunsigned(F.xxhash64("id"), 64 - bits) if bits else F.lit(0)))
    # terms are counted in their row; what a document has for a part goes there as one text and its counts, the only time that terms are shuffled
    at_change = lambda of, differs: F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: (i == 0) | differs(i))
    length = lambda starts, of: lambda p, i: F.coalesce(F.get(starts, i + 1), F.size(of)) - p
    words = sized.where("size > 0").select("id", "size", "block", F.sort_array("terms").alias("terms"))
    begun = words.withColumn("starts", at_change("terms", lambda i: F.get("terms", i) != F.get("terms", i - 1)))
    often = length("starts", "terms")
    once = begun.select("id", "size", "block", F.sort_array(F.transform("starts", lambda p, i: F.struct(_head(F.get("terms", p)).alias("head"), F.get("terms", p).alias("term"), often(p, i).alias("n")))).alias("terms"))
    parted = once.withColumn("starts", at_change("terms", lambda i: F.get("terms", i)["head"] != F.get("terms", i - 1)["head"]))
    own = parted.select("id", "size", "block", F.explode(F.transform("starts", lambda p, i: F.slice("terms", p + 1, often(p, i)))).alias("terms"))
    slices = math.ceil(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) / SLICE)
    sent = own.select("id", "size", "block", F.col("terms")[0]["head"].alias("head"), F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice"), F.array_join("terms.term", " ").alias("words"), F.col("terms.n").alias("often")).repartition("head", "slice")
    each = sent.select("id", "size", "block", "head", "slice", F.explode(F.arrays_zip(F.split("words", " ").alias("term"), F.col("often").alias("n"))).alias("t")).select("id", "size", "block", "head", "slice", "t.*")
    rows = each.groupBy("head", "slice", "block", "term").agg(F.max("n").alias("most"), F.min("size").alias("shortest"), F.sort_array(F.collect_list(F.struct("id", "n", "size"))).alias("entries"))
    ordered = rows.select("term", "block", "most", "shortest", "entries", "head").sortWithinPartitions("head", "term", "block")
    ordered.write.partitionBy("head").parquet(f"{index.path}/postings/segment={number}")
    sized.select("id", "size", "block").write.parquet(f"{index.path}/docs/segment={number}")
    return docs.sparkSession.read.parquet(f"{index.path}/docs/segment={number}")


def _commit(spark: SparkSession, index: Index, number: int, docs: int, words: int) -> Index:
    segments = [*index.segments, number]
    spark.createDataFrame([(number, docs, words, index.stemmed)], "number int, docs long, words long, stemmed boolean").coalesce(1).write.mode("append").parquet(f"{index.path}/totals")
    return Index(index.path, index.stemmed, docs, words, segments)


def build(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text", stemmed: bool = False) -> Index:
    """A new index of ``docs`` at ``path``, which must not hold one. Ids should be unique; null ids are not indexed, null texts are empty."""
    index, docs = Index(path, stemmed, 0, 0, []), docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    told = _write(docs, index, 0, id_col, text_col).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    return _commit(docs.sparkSession, index, 0, told["n"], told["words"])


def opened(spark: SparkSession, path: str) -> Index:
    """The index stored at ``path``."""
    rows = sorted(spark.read.parquet(f"{path}/totals").collect(), key=lambda r: r["number"])  # a row for each segment
    return Index(path, rows[-1]["stemmed"], rows[-1]["docs"], rows[-1]["words"], [r["number"] for r in rows])


def _read(spark: SparkSession, index: Index, kind: str) -> DataFrame:
    return spark.read.option("basePath", f"{index.path}/{kind}").parquet(*[f"{index.path}/{kind}/segment={n}" for n in index.segments if kind != "gone" or n])


def live(spark: SparkSession, index: Index) -> DataFrame:
    """(id, size, block, segment) of the documents as they are now."""
    docs = _read(spark, index, "docs")
    return docs if len(index.segments) == 1 else docs.join(_read(spark, index, "gone").select("id", F.col("was").alias("segment")), ["id", "segment"], "left_anti")


def upsert(index: Index, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> Index:
    """The index with ``docs`` added or put in the place of those with their ids; a null text takes the document out."""
    spark, number = docs.sparkSession, max(index.segments) + 1
    docs = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    old = cut(live(spark, index).join(docs.select("id").distinct(), "id", "left_semi").select("id", "size", F.col("segment").alias("was")))
    new = _write(docs, index, number, "id", "text")
    old.select("id", "was").write.parquet(f"{index.path}/gone/segment={number}")
    count = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    lost, won = count(old), count(new)
    return _commit(spark, index, number, index.docs - lost["n"] + won["n"], index.words - lost["words"] + won["words"])


def _named(terms: list[str], prefix: bool) -> Column:
    """Which postings are of ``terms``, in a form that parts and row groups can be chosen by."""

    def one(t: str) -> Column:
        if not prefix:
            return (F.col("head") == _head_of(t)) & (F.col("term") == t)
        within = (F.col("term") >= t) & (F.col("term") < t + "\U0010ffff")
        return within & (F.col("head") == _head_of(t)) if len(t) > 1 else within

    return reduce(lambda p, q: p | q, map(one, terms))


def _head_of(term: str) -> Column:
    return _head(F.lit(term))


def postings(spark: SparkSession, index: Index, terms: list[str], prefix: bool = False) -> DataFrame:
    """(at, block, most, shortest, entries, segment): the blocks that hold the term at place ``at`` of ``terms``, or words it begins."""
    kind = _read(spark, index, "docs").schema["id"].dataType.simpleString()
    schema = f"term string, block long, most int, shortest int, entries array<struct<id:{kind},n:int,size:int>>, segment int, head int"  # a segment may hold no postings
    folders = [f"{index.path}/postings/segment={n}" for n in index.segments]
    rows = spark.read.schema(schema).option("basePath", f"{index.path}/postings").parquet(*folders).where(_named(terms, prefix))
    fits = lambda t: F.col("term").startswith(t) if prefix else F.col("term") == t
    ats = F.array_compact(F.array(*[F.when(fits(t), F.lit(i)) for i, t in enumerate(terms)]))
    return rows.select(F.explode(ats).alias("at"), "block", "most", "shortest", "entries", "segment")


def _hits(spark: SparkSession, index: Index, blocks: DataFrame) -> DataFrame:
    """(at, id, n, size) of the entries of live documents."""
    entries = blocks.select("at", "segment", F.explode("entries").alias("e")).select("at", "segment", "e.*")
    if len(index.segments) > 1:
        entries = entries.join(_read(spark, index, "gone").select("id", F.col("was").alias("segment")), ["id", "segment"], "left_anti")
    return entries.groupBy("id", "size", "at").agg(F.sum("n").alias("n"))


def _weights(index: Index, hits: DataFrame, terms: list[str], rare_only: bool) -> list[float]:
    """What each term weighs, by the number of documents that have it: one row of numbers."""
    told = hits.agg(*[F.count_if(F.col("at") == i).alias(f"d{i}") for i in range(len(terms))]).first()
    ratio = [(index.docs - d + 0.5) / (d + 0.5) for d in told]
    return [max(math.log(r), 1e-6) if rare_only else math.log(1 + r) for r in ratio]


def _score(n: Column, size: Column, weight: Column | float, mean: float) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return weight * n * (K1 + 1) / (n + K1 * (1 - B + B * size / F.lit(mean)))


def _scored(hits: DataFrame, terms: list[str], weights: list[float], mean: float, every: bool) -> DataFrame:
    """(id, score); terms are added in their order, so that a score does not depend on how rows met."""
    n = lambda i: F.coalesce(F.col(f"n{i}"), F.lit(0))
    rows = hits.groupBy("id", "size").agg(*[F.sum(F.when(F.col("at") == i, F.col("n"))).alias(f"n{i}") for i in range(len(terms))])
    score = reduce(lambda p, q: p + q, [_score(n(i), F.col("size"), w, mean) for i, w in enumerate(weights)], F.lit(0.0))
    if every:
        rows = rows.where(reduce(lambda p, q: p & q, [F.col(f"n{i}").isNotNull() for i in range(len(terms))]))
    return rows.select("id", F.round(score, 6).alias("score"))


def search(spark: SparkSession, index: Index, query: str | list[str], prefix: bool = True, every: bool = True) -> DataFrame:
    """(id, score) of the documents with every word of ``query`` (or any, if not ``every``), by BM25.

    A word of the query stands for all words it begins if ``prefix``; in a stemmed index words are stemmed first.
    A query without words finds nothing.
    """
    terms = _query_terms(spark, index, query)
    if not terms:
        return _read(spark, index, "docs").limit(0).select("id", F.lit(0.0).alias("score"))
    hits = cut(_hits(spark, index, postings(spark, index, terms, prefix)))
    return _scored(hits, terms, _weights(index, hits, terms, prefix), index.mean, every)


def _query_terms(spark: SparkSession, index: Index, query: str | list[str]) -> list[str]:
    words = list(dict.fromkeys(words_of(query) if isinstance(query, str) else query))
    if not index.stemmed or not words:
        return words
    stems = spark.range(1).select(*[stem(F.lit(w)).alias(f"s{i}") for i, w in enumerate(words)]).first()
    return list(dict.fromkeys(stems))


def best(spark: SparkSession, index: Index, query: str | list[str], k: int, prefix: bool = False) -> DataFrame:
    """(id, score, rank) of the ``k`` best documents with any word of ``query``, ties to the smaller id.

    Blocks are bounded by what stands beside their entries. The blocks of the highest bounds are scored first; the k-th score found
    there is a floor, and of the other blocks only those whose bound reaches it are opened, joined and scored.
    """
    terms = _query_terms(spark, index, query)
    order = [F.desc("score"), F.col("id")]
    ranked = lambda df: df.orderBy(*order).limit(k)
    if not terms:
        return search(spark, index, []).withColumn("rank", F.lit(0)).limit(0)
    named = postings(spark, index, terms, prefix)
    weights = _weights(index, _hits(spark, index, named), terms, prefix)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("at") + 1)
    most, shortest = (F.sum("most"), F.min("shortest")) if prefix else (F.max("most"), F.min("shortest"))
    each = named.groupBy("block", "at").agg(most.alias("most"), shortest.alias("shortest"))
    bounds = cut(each.select("block", _score(F.col("most"), F.col("shortest"), weight, index.mean).alias("bound")).groupBy("block").agg(F.sum("bound").alias("bound")))
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
    scored = lambda blocks: _scored(_hits(spark, index, blocks), terms, weights, index.mean, False)
    early = cut(ranked(scored(named.where(F.col("block").isin(first)))))
    floor = early.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    rest = bounds.where(~F.col("block").isin(first))
    if floor["n"] == k:
        rest = rest.where(F.col("bound") >= floor["least"] - 1e-6)  # scores are rounded
    told = early.unionByName(scored(named.join(rest.select("block"), "block", "left_semi")))
    return ranked(told).select("id", "score", F.row_number().over(Window.orderBy(*order)).alias("rank"))
