"""Language identification by rank-order profiles.

A language's profile ranks its most frequent character n-grams. A document's own ranking
is compared to each profile by the out-of-place distance: the difference in rank of every
gram, or the greatest distance where the profile lacks it; the nearest profile wins.

Spark counts the grams of all learning documents (tasks pre-aggregate, the counts meet in
one shuffle); profiles have a fixed length, and so does what is broadcast per language.

Defined cases: a null text and a text without a letter are ``und`` with score 0; with
nothing learned every document is ``und``; a null id counts as the empty string in the
split of held-out documents; equally frequent grams rank by their number, equally near
languages by name; whole texts are read; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.scratch import forget, give_back

PROFILE = 400
LONGEST = 4  #: four UTF-16 units fill a 64-bit gram
UNKNOWN = "und"
#: A text that scores less under its nearest profile is rejected; 0 rejects none with a letter.
LEAST_SCORE = 0.0
#: Parts of a language's grams that are ranked apart before the best of all parts are.
RANK_PARTS = 32
#: Grams that a task holds before it counts them.
HELD = 2_000_000
_NO_LETTERS = re.compile(r"[\W\d_]+")
_EDGE = np.uint64(ord("_"))


def grams_of(text: str | None) -> np.ndarray:
    """The 1- to 4-grams of the words of ``text``, each word between two edge marks.

    A gram is a 64-bit number of UTF-16 units; none reaches across an edge mark.
    """
    if not text or not any(map(str.isalpha, text)):
        return np.empty(0, np.int64)
    marked = f"_{_NO_LETTERS.sub('_', text.lower()).strip('_')}_"
    units = np.frombuffer(marked.encode("utf-16-le"), np.uint16).astype(np.uint64)
    letter = units != _EDGE
    grams, inner, out = units, None, [units[letter]]
    for n in range(2, LONGEST + 1):
        grams = (grams[:-1] << np.uint64(16)) | units[n - 1 :]
        if n == 3:
            inner = letter[1:-1]
        elif n > 3:
            inner = inner[:-1] & letter[n - 2 : -1]
        out.append(grams if inner is None else grams[inner])
    return np.concatenate(out).view(np.int64)


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == fold


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def settle(lang: str) -> None:
        new = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        counts[lang] = _merged([counts[lang], new]) if lang in counts else new
        sizes[lang] = 0

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if len(grams := grams_of(text.as_py())):
                held.setdefault(lang, []).append(grams)
                sizes[lang] = sizes.get(lang, 0) + len(grams)
                if sizes[lang] > HELD:
                    settle(lang)
    for lang in list(held):
        settle(lang)
    for lang, (grams, n) in counts.items():
        for at in range(0, len(grams), 50_000):
            some = grams[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[at : at + 50_000])], names=["lang", "gram", "n"])
    give_back()


def profiles(labelled: DataFrame, length: int = PROFILE) -> DataFrame:
    """(lang, rank, gram) from rows of (lang, text), at most ``length`` a language."""
    counts = labelled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.col("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(RANK_PARTS))
    some = counts.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= length)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= length).select("lang", "rank", "gram")


class Ranks:
    """The profiles as a table of ranks: a row per gram, a column per language."""

    def __init__(self, rows: list[tuple[str, int, int]], length: int = PROFILE):
        self.length, self.langs = length, sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[2] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank - 1

    def nearest(self, text: str | None) -> tuple[str, float]:
        every = grams_of(text)
        if not len(every) or not self.langs:
            return UNKNOWN, 0.0
        return self.of_grams(*np.unique(every, return_counts=True))

    def of_grams(self, grams: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """The nearest language; with nothing learned none, at the best score, as none is then a reason to reject."""
        if not self.langs:
            return UNKNOWN, 1.0
        own = grams[np.argsort(-counts, kind="stable")[: self.length]]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.length * len(own)))


def identify(docs: DataFrame, model: list[tuple[str, int, int]], id_col: str = "doc_id", text_col: str = "text", length: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``model`` holds the collected profiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ranks = Ranks(model, length)
        for batch in batches:
            got = [ranks.nearest(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", length: int = PROFILE) -> list[tuple[str, int, int]]:
    """The profiles of the learning folds, on the driver: ``length`` rows a language."""
    labelled = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return [tuple(r) for r in profiles(labelled, length).collect()]


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE, lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language, which ``lang_col`` names from then on; all other columns are kept.

    Labels given before are what is learned from; a row's own may be missing or wrong, and the nearest profile replaces it. Rejected are null texts, texts without a letter and, at every length, texts whose nearest profile scores under
    ``least_score``, which is for the caller to set by their own texts. With nothing learned every text with a letter stays, with its label.
    """
    model = learn(docs, id_col, text_col, lang_col)
    place, named = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ranks = Ranks(model)

        for batch in batches:
            found = [ranks.of_grams(*grams) if len((grams := np.unique(grams_of(t.as_py()), return_counts=True))[0]) else None for t in batch.column(place)]
            if ranks.langs:
                langs = pa.array([f and f[0] for f in found], pa.string()).cast(batch.schema.field(named).type)
                batch = batch.set_column(named, batch.schema.field(named), langs)
            yield batch.filter(pa.array([f is not None and f[1] >= least_score for f in found], pa.bool_()))
        give_back()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots or clashes don't matter
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
