"""Phrase collocations, mined level by level with hashed bucket counts.

A pass over the texts counts the phrases of one length exactly and, in a fixed array of small
counters, the phrases of the next length by hash. Buckets that reach the least count become a
bitmap of fixed size, which is broadcast, as is one of the phrases found frequent. The next pass
counts a phrase exactly only if all its parts and its own bucket are set; a bit too many costs a
counted row, never a wrong answer, for exact counts decide. Counters stop at the least count, so
sums of stopped counters still tell whether it was reached.

Tasks count slices of texts as arrays and send each phrase once per slice; Spark adds up per
phrase, with partial sums in the tasks. Counters go by range of buckets and are added up as they
stream in. Bitmaps have ``1 << bits`` bits whatever the input: with far more rare phrases
than buckets all bits are set and nothing is pruned, so ``bits`` should grow with the corpus.

Defined cases: a null text is empty and a null language is ``und``, as is the language of that
name; repeated rows are texts of their own, ids are not read; whole texts are read, of any length;
languages without words give nothing; an empty table gives an empty result; further columns are
ignored. Phrases equal in score and count rank in UTF-8 order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.blocks import mixed, packed, unpacked
from weftgraph.llm.scratch import forget, give_back, stage
from weftgraph.llm.tokens import Words, kinds, slices, text_of

LEAST, LONGEST, TOP, PERCENT = 10, 3, 2000, 50
UNKNOWN = "und"
BITS = 24
#: Counters that travel together.
RANGE_BITS = 16
#: Parts in which a language's phrases are ranked, and a word's phrases are joined, apart.
PARTS = 16
SCALE = 1_000_000
WORDS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
ROWS = "size int, lang string, phrase string, n long, range int, counters binary"
_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)


def _hash_of(values: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(v) for v in values], np.uint64)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its beginning and its last word."""
    return mixed(first * _FACTOR + second)


def _set(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> _U(64 - bits)
    return (bitmap[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & np.uint8(1) > 0


class _Slice:
    """Phrases of one to three words in a slice of texts; each array entry is a place where one begins."""

    def __init__(self, langs: pa.ChunkedArray, texts: pa.ChunkedArray):
        words = Words(texts, WORDS)
        coded = langs.combine_chunks().dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        of_row, many = coded.indices.to_numpy(), max(len(words.distinct), 1)
        seen, word, self.times = np.unique(of_row[words.row].astype(np.int64) * many + words.code, return_inverse=True, return_counts=True)
        self.word = word.astype(np.int32)  # a slice is far shorter than that
        self.lang = coded.dictionary.take(pa.array(seen // many))
        self.text = words.distinct.take(pa.array(seen % many))
        self.hash = _hash_of(words.distinct.to_pylist())[seen % many] if len(seen) else np.empty(0, np.uint64)
        if len(seen):
            self.hash = mixed(self.hash ^ _hash_of([v.encode() for v in coded.dictionary.to_pylist()])[seen // many])
        self.next = words.next

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pairs begin, and the two words of each."""
        at = np.flatnonzero(self.next).astype(np.int32)
        return at, self.word[at], self.word[at + 1]

    def rows(self, *words: np.ndarray, size: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Phrases, given by their words' numbers, with their counts."""
        for i in range(0, len(n), 50_000):
            part = [w[i : i + 50_000] for w in words]
            lang = self.lang.take(pa.array(part[0]))
            text = text_of(pc.binary_join_element_wise(*(self.text.take(pa.array(w)) for w in part), b" "))
            yield _rows(size, lang, text, n[i : i + 50_000])


def _rows(size: int, lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    many = len(n)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(many, size, np.int32)), lang.cast(pa.string()), phrase, pa.array(n.astype(np.int64)), pa.nulls(many, pa.int32()), pa.nulls(many, pa.binary())],
        names=["size", "lang", "phrase", "n", "range", "counters"],
    )


class _Counters:
    """Small counters by hash that stop at ``least``."""

    def __init__(self, bits: int, least: int):
        self.bits, self.least = bits, least
        self.n = np.zeros(1 << bits, np.uint8 if least < 256 else np.uint32)

    def add(self, hashes: np.ndarray, times: np.ndarray | None = None) -> None:
        if times is None:
            hashes, times = np.unique(hashes >> _U(64 - self.bits), return_counts=True)
        at = hashes.astype(np.int64)
        self.n[at] = np.minimum(self.n[at] + times, self.least)

    def rows(self) -> Iterator[pa.RecordBatch]:
        width = min(1 << RANGE_BITS, len(self.n))
        for i, some in enumerate(self.n.reshape(-1, width)):
            if some.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, t) for t in (pa.int32(), pa.string(), pa.string(), pa.int64())] + [pa.array([i], pa.int32()), pa.array([packed(some.tobytes())], pa.binary())],
                    names=["size", "lang", "phrase", "n", "range", "counters"],
                )


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _one_word(bits: int, least: int):
    """Counts words, and pairs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        buckets = _Counters(bits, least)
        for some in slices(batches, 1):
            s = _Slice(some.column(0), some.column(1))
            yield from s.rows(np.arange(len(s.times)), size=1, n=s.times)
            _, first, second = s.pairs()
            buckets.add(_joined(s.hash[first], s.hash[second]))
        yield from buckets.rows()
        give_back()

    return run


def _two_words(bits: int, least: int, frequent: Broadcast, bucket: Broadcast):
    """Counts pairs of frequent words in set buckets, and by bucket the triples made of two such pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        buckets, words, pairs = _Counters(bits, least), np.frombuffer(frequent.value, np.uint8), np.frombuffer(bucket.value, np.uint8)
        for some in slices(batches, 1):
            s = _Slice(some.column(0), some.column(1))
            if not len(s.times):
                continue
            often = _set(words, s.hash, bits)
            at, first, second = s.pairs()
            may = often[first] & often[second]
            at, first, second = at[may], first[may], second[may]
            whole = _joined(s.hash[first], s.hash[second])
            may = _set(pairs, whole, bits)
            at, first, second, whole = at[may], first[may], second[may], whole[may]
            goes_on = np.flatnonzero(at[1:] == at[:-1] + 1)
            buckets.add(_joined(whole[goes_on], s.hash[second[goes_on + 1]]))
            del at, whole, may, goes_on
            keys, n = _repeats(first.astype(np.int64) << 32 | second)
            del first, second
            yield from s.rows(keys >> 32, keys & 0xFFFFFFFF, size=2, n=n)
        yield from buckets.rows()
        give_back()

    return run


def _three_words(bits: int, frequent: Broadcast, bucket: Broadcast):
    """Counts triples made of two frequent pairs in set buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        pairs, triples = np.frombuffer(frequent.value, np.uint8), np.frombuffer(bucket.value, np.uint8)
        for some in slices(batches, 1):
            s = _Slice(some.column(0), some.column(1))
            if not len(s.times):
                continue
            at, first, second = s.pairs()
            whole = _joined(s.hash[first], s.hash[second])
            may = _set(pairs, whole, bits)
            at, first, second, whole = at[may], first[may], second[may], whole[may]
            goes_on = np.flatnonzero(at[1:] == at[:-1] + 1)
            goes_on = goes_on[_set(triples, _joined(whole[goes_on], s.hash[second[goes_on + 1]]), bits)]
            seen, pair = np.unique(first[goes_on].astype(np.int64) << 32 | second[goes_on], return_inverse=True)
            keys, n = _repeats(pair.astype(np.int64) << 32 | second[goes_on + 1])
            del at, first, second, whole, may, goes_on, pair
            start = seen[keys >> 32]
            yield from s.rows(start >> 32, start & 0xFFFFFFFF, keys & 0xFFFFFFFF, size=3, n=n)
        give_back()

    return run


def _reached(bits: int, least: int):
    """Bitmaps of the ranges whose counters stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        kind = np.uint8 if least < 256 else np.uint32
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                some = np.frombuffer(unpacked(data), kind)
                sums[i] = np.minimum(sums[i] + some.astype(np.uint32), least).astype(kind) if i in sums else some
        for i, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(n >= least, bitorder="little").tobytes()], pa.binary())], names=["range", "bits"])
        give_back()

    return run


def _marked(bits: int):
    """Counters, full at once, of the phrases (lang, phrase) given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        buckets = _Counters(bits, 1)
        for batch in batches:
            codes, langs = pd.factorize(pd.Series(batch.column(0).to_pylist(), dtype=object))
            if not len(codes):
                continue
            of_lang = _hash_of([v.encode() for v in langs])[codes]
            words = [p.split(b" ") for p in batch.column(1).cast(pa.binary()).to_pylist()]
            hashes = mixed(_hash_of([w[0] for w in words]) ^ of_lang)
            for k in range(1, len(words[0])):
                hashes = _joined(hashes, mixed(_hash_of([w[k] for w in words]) ^ of_lang))
            buckets.add(hashes)
        for batch in buckets.rows():
            yield batch.select(["range", "counters"])
        give_back()

    return run


def _bitmap(counters: DataFrame, bits: int, least: int) -> Broadcast:
    """The bitmap of ``counters`` (range, counters), ``1 << bits`` bits, on all executors."""
    ranges = max(1 << (bits - RANGE_BITS), 1) if bits > RANGE_BITS else 1
    whole = bytearray((1 << bits) // 8)
    width = len(whole) // ranges
    for at, some in counters.repartition(min(ranges, 64), "range").mapInArrow(_reached(bits, least), "range int, bits binary").collect():
        whole[at * width : (at + 1) * width] = some
    return counters.sparkSession.sparkContext.broadcast(bytes(whole))


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, phrase, n) of the phrases of one, two and three words that occur ``least`` times."""
    if not RANGE_BITS // 2 <= bits <= 30:
        raise ValueError("bits must be from 8 to 30")
    clean = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def often(told: DataFrame) -> DataFrame:
        return stage(told.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")

    def buckets(told: DataFrame) -> Broadcast:
        return _bitmap(told.where("range IS NOT NULL").select("range", "counters"), bits, least)

    def marks(frequent: DataFrame) -> Broadcast:
        return _bitmap(frequent.select("lang", "phrase").mapInArrow(_marked(bits), "range int, counters binary"), bits, 1)

    told = stage(clean.mapInArrow(_one_word(bits, least), ROWS), "pass-1")
    words, all_words = often(told), told.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    told = stage(clean.mapInArrow(_two_words(bits, least, marks(words), buckets(told)), ROWS), "pass-2")
    pairs = often(told)
    told = clean.mapInArrow(_three_words(bits, marks(pairs), buckets(told)), ROWS)
    return all_words, words, pairs, often(told)


def _looked_up(rows: DataFrame, key: str, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``key``; rows of one phrase are dealt in ``PARTS`` parts."""
    own = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int"))
    every = found.select("lang", F.col("phrase").alias(key), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return own.join(every, ["lang", key, "part"]).drop("part")


def _score(a: str, left: str, right: str) -> Column:
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or three words."""
    all_words, words, pairs, triples = counted(docs, text_col, lang_col, least, bits)
    word = lambda k: F.element_at(F.split("phrase", " "), k)
    cut = lambda a, b: F.concat_ws(" ", word(a), word(b))

    two = pairs.select("lang", "phrase", F.col("n").alias("a"), word(1).alias("first"), word(2).alias("last"))
    two = _looked_up(_looked_up(two, "first", words, "l"), "last", words, "r").withColumn("score", _score("a", "l", "r"))
    held = triples.select("lang", "n", F.explode(F.array_distinct(F.array(cut(1, 2), cut(2, 3)))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    two = two.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))

    three = triples.select("lang", "phrase", F.col("n").alias("a"), word(1).alias("first"), cut(2, 3).alias("rest"), cut(1, 2).alias("start"), word(3).alias("last"))
    for key, found, name in (("first", words, "l1"), ("rest", pairs, "r1"), ("start", pairs, "l2"), ("last", words, "r2")):
        three = _looked_up(three, key, found, name)
    ways = [F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = three.withColumn("way", F.array_min(F.array(*ways)))

    columns = ["lang", "phrase", "a", "l", "r", "score"]
    every = two.select(*columns).unionByName(three.select("lang", "phrase", "a", "way.l", "way.r", "way.score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    in_part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))
    best = every.withColumn("rank", in_part).where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(all_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT row, lang, piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT row, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS piece_no
    FROM (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents))),
w AS (SELECT lang, row, piece_no, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM pieces),
s AS (SELECT lang, word AS x, lead(word, 1) OVER p AS y, lead(word, 2) OVER p AS z FROM w WINDOW p AS (PARTITION BY row, piece_no ORDER BY place)),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, x AS phrase, count(*) AS n FROM s GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y, count(*) FROM s WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, count(*) FROM s WHERE z IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS p FROM f WHERE n >= 10 AND contains(phrase, ' ')),
cuts AS (
  SELECT lang, phrase, a, len(p) AS size, k, array_to_string(p[1:k], ' ') AS start, array_to_string(p[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM c)),
found AS MATERIALIZED (SELECT lang, phrase, n FROM f SEMI JOIN (SELECT lang, start AS phrase FROM cuts UNION ALL SELECT lang, rest FROM cuts) USING (lang, phrase)),
scored AS (
  SELECT t.lang, t.phrase, t.a, t.size, t.k, l.n AS l, r.n AS r, (1000000::HUGEINT * t.a * t.a // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts t JOIN found l ON l.lang = t.lang AND l.phrase = t.start JOIN found r ON r.lang = t.lang AND r.phrase = t.rest),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, inner_phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS inner_phrase FROM c WHERE len(p) = 3) GROUP BY ALL),
left_over AS (
  SELECT x.* FROM least x LEFT JOIN longer g ON g.lang = x.lang AND g.inner_phrase = x.phrase
  WHERE x.size = 3 OR g.a IS NULL OR 100 * g.a < 50 * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
