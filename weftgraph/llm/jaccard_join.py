"""N-gram Jaccard join with set-relation skipping.

A document's set are its distinct shingles of five words. Equal sets are one set from the
start. All shingles are counted, block by block; a set that shares too few of its shingles
with others to reach the threshold has no partner and ends there. The others enter an index:
each lists its prefix, its rarest shingles by global count, with set size and position.

Relations among sets then replace work on all pairs of a list. Every set is first compared
to the pivot it shares most lists with, the most typical set of a list. Sets that a pivot
links are in one component, and pairs of one component need no answer of their own. For the
rest, lists are met again, but blocks of sizes and positions that cannot reach the threshold
are skipped, and so are pairs that their distances to a common pivot keep apart (Jaccard
distance obeys the triangle inequality); those that the same distances bring together are
linked without reading the sets.

Defined cases: null and empty texts have no set and are linked with nothing; a text of fewer
than five words is one shingle of all of them; rows that repeat an id are told apart by
their sets (``keep_one``: by their texts); a null id never is a component's smallest unless it is alone; an empty table
gives an empty result; further columns are ignored. Sets are told apart by 128-bit digests;
within two sets that are compared, shingles stand for themselves by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import blocks as bl
from weftgraph.llm.components import connected
from weftgraph.llm.scratch import stage

WORDS, PERCENT = 5, 80
#: Sizes whose ratio is below the threshold lie at least two of these steps apart.
SIZE_STEP = 1.25
_U = np.uint64
_COUNTED = _U(((1 << 64) - 1) ^ ((1 << 20) - 1))  #: counts go by 44 bits; more can only add to them
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SETS = "doc_id long, block long, place int, n_shingles long, set_id binary, row_key binary"
INDEXED = "set_id binary, n int, alone int, shingles array<long>, prefix array<long>"
#: Totals stop here; a shingle this frequent is as common as any.
MOST_COUNTED = (1 << 32) - 1


class Shingles:
    """The distinct shingles of each document of a block: ``hashes``, those of document i from first[i] on."""

    def __init__(self, block: bl.Block, size: int):
        block.bytes = _LOWER[block.bytes]
        begin, end, at = block.words()
        words = bl.Sums(bl.byte_sums(block.bytes).of(begin, end))
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), np.where(n >= size, n - size + 1, n > 0))
        starts = np.arange(len(doc)) - np.searchsorted(doc, doc) + at[:-1][doc]
        hashes = words.of(starts, np.minimum(starts + size, at[1:][doc]))
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.empty(0, bool)
        self.hashes, self.doc = hashes[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(n) + 1))

    def digests(self) -> list[bytes]:
        """What names each document's set."""
        data = self.hashes.tobytes()
        return [hashlib.blake2b(data[8 * i : 8 * j], digest_size=16).digest() for i, j in zip(self.first, self.first[1:], strict=False)]


def _counted(parts: list[Shingles]) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct shingles, and how many of its documents have each."""
    hashes, which = np.unique(np.concatenate([s.hashes & _COUNTED for s in parts]), return_inverse=True)
    return hashes, np.bincount(which, minlength=len(hashes)).astype(np.uint32)


def _describe(size: int, keyed: bool):
    def run(number: int, parts: bl.Parts, _: dict) -> Iterator[pa.RecordBatch]:
        at = 0
        for part in parts:
            s, spans = Shingles(part, size), zip(part.ids, part.begin, part.end, strict=True)
            n = np.diff(s.first)
            keys = [hashlib.md5(f"{'' if i is None else i}:".encode() + part.raw[b:e]).digest() if keyed else None for i, b, e in spans]
            yield bl.table({
                "doc_id": (part.ids, pa.int64()), "block": ([number] * len(n), pa.int64()), "place": (np.arange(at, at + len(n)), pa.int32()),
                "n_shingles": (n, pa.int64()), "set_id": (s.digests(), pa.binary()), "row_key": (keys, pa.binary()),
            })
            at += len(n)

    return run


def _ask(size: int, by: bl.Cut):
    def run(number: int, parts: bl.Parts, _: dict) -> Iterator[pa.RecordBatch]:
        yield bl.cells(number, *_counted([Shingles(p, size) for p in parts]), by)

    return run


def _total(hashes: np.ndarray, _: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count over all blocks where other blocks have the shingle too, zero elsewhere."""
    _, which = np.unique(hashes, return_inverse=True)
    totals = np.minimum(np.bincount(which, weights=counts)[which], MOST_COUNTED).astype(np.uint32)
    return np.where(totals > counts, totals, 0).astype(np.uint32)


def _index(size: int, percent: int, by: bl.Cut):
    def run(number: int, parts: bl.Parts, row: dict) -> Iterator[pa.RecordBatch]:
        every = [Shingles(p, size) for p in parts]
        hashes, counts = _counted(every)
        totals = np.maximum(bl.said_of(hashes, row["replies"], by, np.uint32), counts).astype(np.int64)
        chosen = sorted(row["classes"] or [], key=lambda c: c["place"])
        before = 0
        for s in every:
            docs = len(s.first) - 1
            yield _prefixes(s, totals[np.searchsorted(hashes, s.hashes & _COUNTED)], [c | {"place": c["place"] - before} for c in chosen if 0 <= c["place"] - before < docs], percent)
            before += docs

    return run


def _prefixes(s: Shingles, totals: np.ndarray, chosen: list[dict], percent: int) -> pa.RecordBatch:
    """The index's rows of the chosen sets of a part; those that can have no partner are left out."""
    out: list[tuple] = []
    for one in chosen:
        own = slice(s.first[one["place"]], s.first[one["place"] + 1])
        held, count = s.hashes[own], totals[own]
        n, need = len(held), -(-percent * len(held) // 100)
        shared = (count > one["members"]) | (count >= MOST_COUNTED)
        if shared.sum() >= need:
            order = np.lexsort((held, held & _COUNTED, count))[: n - need + 1]
            # a place in the prefix that no other set can share stays as a zero
            prefix = np.where(shared[order], held[order].view(np.int64), 0)
            out.append((one["set_id"], n, int(n - shared.sum()), held.view(np.int64), prefix))
    types = (pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return bl.table({n: ([o[i] for o in out], t) for i, (n, t) in enumerate(zip(("set_id", "n", "alone", "shingles", "prefix"), types, strict=True))})


def _compared(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the sizes of intersection and union of their sets."""
    left = index.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa"))
    right = index.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.withColumn("common", F.size(F.array_intersect("sa", "sb"))).withColumn("union", F.size("sa") + F.size("sb") - F.col("common")).drop("sa", "sb")


def similar_sets(index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs at or over the threshold."""
    lists = stage(index.select("set_id", "n", (F.col("alone") / F.col("n")).alias("odd"), F.posexplode("prefix").alias("pos", "token")).where("token <> 0"), "lists")
    pivots = lists.groupBy("token").agg(F.min(F.struct("odd", "set_id")).alias("p"), F.count("*").alias("length")).where("length > 1").select("token", F.col("p.set_id").alias("b"))
    shares = lists.join(pivots, "token").where("set_id <> b").groupBy(F.col("set_id").alias("a"), "b").count()
    first = Window.partitionBy("a").orderBy(F.desc("count"), "b")
    chosen = shares.withColumn("k", F.row_number().over(first)).where("k = 1").select("a", "b")
    known = stage(_compared(chosen, index).select("a", "b", "common", "union"), "known")
    links = known.where(f"100 * common >= {percent} * union").select("a", "b")
    labels = connected(links)

    # the same lists again, for what the pivots left apart
    far = F.col("union").cast("double") - F.col("common")
    own = known.select(F.col("a").alias("set_id"), F.col("b").alias("pivot"), (far / F.col("union")).alias("far"))
    itself = known.select(F.col("b").alias("set_id")).distinct()
    own = own.unionByName(itself.select("set_id", F.col("set_id").alias("pivot"), F.lit(0.0).alias("far")))
    placed = lists.join(labels.withColumnsRenamed({"id": "set_id"}), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    mixed_lists = placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    rest = stage(placed.join(mixed_lists, "token", "left_semi").withColumn("band", step), "rest")
    left = rest.select("token", F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = rest.select("token", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"), "band")
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # shingles that both may still share from here on
    pairs = left.join(right, ["token", "band"]).where((F.col("la") < F.col("lb")) & (100 * reach * (100 + percent) >= 100 * percent * (F.col("na") + F.col("nb")))).select("a", "b").distinct()
    apart = 1 - percent / 100 + 1e-9
    da, db = own.toDF("a", "pivot", "far_a"), own.toDF("b", "pivot_b", "far_b")
    common = pairs.join(da, "a").join(db, ["b"]).where("pivot = pivot_b").groupBy("a", "b").agg(F.max(F.abs(F.col("far_a") - F.col("far_b"))).alias("least"), F.min(F.col("far_a") + F.col("far_b")).alias("most"))
    judged = stage(pairs.join(common, ["a", "b"], "left"), "judged")
    derived = judged.where(F.col("most") <= 1 - percent / 100 - 1e-9).select("a", "b")
    read = judged.where(F.coalesce(F.col("least") <= apart, F.lit(True)) & F.coalesce(F.col("most") > 1 - percent / 100 - 1e-9, F.lit(True)))
    more = _compared(read.select("a", "b"), index).where(f"100 * common >= {percent} * union").select("a", "b")
    return links.unionByName(derived).unionByName(more)


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, keyed: bool = False, bucket_bytes: int = bl.BUCKET_BYTES, fan: int = bl.FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and (set_id, label, component_id) of every set; a label stands for one component."""
    blocks = bl.make_blocks(docs, id_col, text_col)
    by = bl.bucket_cut(blocks, bucket_bytes, fan)
    sets = stage(bl.each_block(blocks, _describe(size, keyed), SETS), "sets")
    classes = sets.where("n_shingles > 0").groupBy("set_id").agg(F.count("*").cast("int").alias("members"), F.min("doc_id").alias("least"), F.min(F.struct("block", "place")).alias("at"))
    by_block = classes.select("at.block", "at.place", "members", "set_id").groupBy("block").agg(F.collect_list(F.struct("place", "members", "set_id")).alias("classes"))
    replies = bl.answered(bl.each_block(blocks, _ask(size, by), bl.CELLS), by, _total, np.uint32)
    asked = bl.with_replies(blocks, replies).join(by_block, "block", "left")
    index = stage(bl.each_block(asked, _index(size, percent, by), INDEXED), "index")
    labels = connected(similar_sets(index, percent)).withColumnRenamed("id", "set_id")
    least = classes.select("set_id", "least").join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    smallest = least.groupBy("label").agg(F.min("least").alias("component_id"))
    return sets, least.join(smallest, "label").select("set_id", "label", "component_id")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT, **cut) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) of every document."""
    sets, found = _grouped(docs, id_col, text_col, size, percent, **cut)
    joined = sets.join(found.drop("label"), "set_id", "left")
    return joined.select("doc_id", "n_shingles", "set_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, all columns kept: the smallest id (null last), then the smallest row key.

    Rows are told apart by id and text together, so ids may be null or repeat; of rows equal in both,
    one stays. Every row without a word is a component of its own.
    """
    sets, found = _grouped(docs, id_col, text_col, WORDS, PERCENT, keyed=True)
    own = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "row_key")).alias("first"))
    kept = own.join(found, "set_id").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row_key").alias("key"))
    text = F.col(text_col)
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), text)))
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # repeats go before the join, task by task, so that a row repeated often is no hot key
    rows = docs.where(worded).select(key.alias("key"), F.struct(F.col("*")).alias("whole"))
    one = rows.dropDuplicates(["key"]).join(kept, "key", "left_semi")
    return one.select("whole.*").unionAll(docs.where(~worded))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON a = w.doc_id
"""
