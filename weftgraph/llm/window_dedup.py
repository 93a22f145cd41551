"""Substring deduplication by Rabin-Karp hashes of every fixed-length token window.

Every window of ``WINDOW`` words is hashed from running sums, twice and independently. A first
pass counts 48 bits of the one hash: windows that no other shares are done. It only excludes.
What is left is told apart by both hashes, 128 bits: per window Spark's tasks find the
smallest id of a document that has it, bucket by bucket, and each block of documents learns
which of its windows also start in a document with a smaller id. A word is removed if such a
window covers it; the removed windows merge into maximal intervals. Windows are judged on the
input, not on what is left.

Defined cases: a null text has no words; texts shorter than a window keep all words; a null
id counts as larger than any other; rows that repeat an id are one document here, so windows
shared among them alone stay; an empty table gives an empty result; further columns are
ignored. Among n different windows about n * n / 2**129 pairs agree in both hashes by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import blocks as bl
from weftgraph.llm.scratch import stage

WINDOW = 13
LAST = np.iinfo(np.int64).max  #: stands for a null id
_COARSE = np.uint64(((1 << 64) - 1) ^ 0xFFFF)
NAMED = np.dtype([("second", np.uint64), ("owner", np.int64)])

RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"


class Windows:
    """The windows of a part: where words and windows lie, each window's document and its two hashes."""

    def __init__(self, block: bl.Block, window: int, hashes: int = 2):
        self.begin, self.end, self.first = block.words()
        self.doc = np.repeat(np.arange(len(block.ids)), np.diff(self.first))
        starts = np.arange(max(0, len(self.begin) - window + 1))
        self.starts = starts[self.doc[starts] == self.doc[starts + window - 1]] if len(starts) else starts
        self.hashes = []
        for factor in bl.FACTORS[:hashes]:
            words = bl.byte_sums(block.bytes, factor).of(self.begin, self.end)
            self.hashes.append(bl.Sums(words, factor).of(self.starts, self.starts + window))
        self.ids = known_ids(block)[self.doc[self.starts]]


class Named:
    """A block's windows that may repeat: distinct by both hashes, in order, each with its smallest document."""

    def __init__(self, parts: list[Windows], replies: list | None, by: bl.Cut):
        first, second = (np.concatenate([w.hashes[i] for w in parts]) for i in (0, 1))
        ids = np.concatenate([w.ids for w in parts])
        coarse, which, counts = np.unique(first & _COARSE, return_inverse=True, return_counts=True)
        self.some = np.flatnonzero(((counts > 1) | bl.said_of(coarse, replies, by))[which])
        h, g, self.ids = first[self.some], second[self.some], ids[self.some]
        order = np.lexsort((self.ids, g, h))
        h, g = h[order], g[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.empty(0, bool)
        self.hashes = h[new]
        self.extra = np.empty(int(new.sum()), NAMED)
        self.extra["second"], self.extra["owner"] = g[new], self.ids[order[new]]
        self.which = np.empty(len(h), np.int64)
        self.which[order] = np.cumsum(new) - 1


def known_ids(block: bl.Block) -> np.ndarray:
    return np.array([LAST if i is None else i for i in block.ids], np.int64)


def _ask(window: int, by: bl.Cut):
    def run(number: int, parts: bl.Parts, _: dict) -> Iterator[pa.RecordBatch]:
        yield bl.cells(number, np.unique(np.concatenate([np.unique(Windows(p, window, 1).hashes[0] & _COARSE) for p in parts])), None, by)

    return run


def _ask_named(window: int, by: bl.Cut):
    def run(number: int, parts: bl.Parts, row: dict) -> Iterator[pa.RecordBatch]:
        named = Named([Windows(p, window) for p in parts], row["replies"], by)
        yield bl.cells(number, named.hashes, named.extra, by)

    return run


def _shared(hashes: np.ndarray, _: np.ndarray, __: None) -> np.ndarray:
    """Whether another block has the hash too."""
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return counts[which] > 1


def _smaller(hashes: np.ndarray, _: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Whether another block has the window in a document with a smaller id."""
    order = np.lexsort((extra["second"], hashes))
    h, g, ids = hashes[order], extra["second"][order], extra["owner"][order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    least = np.minimum.reduceat(ids, new)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(least, np.diff(np.append(new, len(h)))) < ids
    return out


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Whether each of ``total`` places lies in a window that starts at one of ``starts``."""
    steps = np.bincount(starts, minlength=total + 1) - np.bincount(np.minimum(starts + length, total), minlength=total + 1)
    return np.cumsum(steps[:total]) > 0


def _remove(window: int, by: bl.Cut):
    def run(number: int, parts: bl.Parts, row: dict) -> Iterator[pa.RecordBatch]:
        windows = [Windows(p, window) for p in parts]
        named = Named(windows, row["replies"], by)
        elsewhere = bl.said_of(named.hashes, row["answers"], by)
        gone = np.zeros(sum(len(w.starts) for w in windows), bool)
        gone[named.some] = elsewhere[named.which] | (named.ids > named.extra["owner"][named.which])
        at = 0
        for part, w in zip(parts, windows, strict=True):
            yield _result(part, w, w.starts[gone[at : at + len(w.starts)]], window)
            at += len(w.starts)

    return run


def _result(block: bl.Block, w: Windows, gone: np.ndarray, window: int) -> pa.RecordBatch:
    """The rows of a part whose windows that start at ``gone`` are removed."""
    off = covered(gone, window, len(w.begin))
    first = w.first
    removed = np.concatenate([[0], np.cumsum(off)])
    rises = np.concatenate([[0], np.cumsum(off & ~np.concatenate([[False], off[:-1] & (w.doc[1:] == w.doc[:-1])]))]) if len(off) else np.zeros(1, int)
    kept = np.flatnonzero(~off)
    steps = np.zeros(len(block.bytes) + 1, np.int8)
    steps[w.begin[kept]] += 1
    steps[w.end[kept]] -= 1
    keep, data = np.cumsum(steps[:-1]).astype(bool), block.bytes.copy()
    more = kept[:-1][w.doc[kept[1:]] == w.doc[kept[:-1]]] if len(kept) else kept
    keep[w.end[more]], data[w.end[more]] = True, 32
    at = np.concatenate([[0], np.cumsum(keep)])
    left = data[keep].tobytes()
    digest = [hashlib.sha256(left[at[i] : at[j]]).hexdigest() for i, j in zip(block.begin, block.end, strict=True)]
    return bl.table({
        "doc_id": (block.ids, pa.int64()), "n_words": (np.diff(first), pa.int64()), "n_removed": (removed[first[1:]] - removed[first[:-1]], pa.int64()),
        "n_spans": (rises[first[1:]] - rises[first[:-1]], pa.int64()), "kept_sha256": (digest, pa.string()),
    })


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bucket_bytes: int = bl.BUCKET_BYTES, fan: int = bl.FAN_BITS) -> DataFrame:
    """Per document: words, removed words, maximal removed runs, digest of what is kept."""
    blocks = bl.make_blocks(docs, id_col, text_col)
    by = bl.bucket_cut(blocks, bucket_bytes, fan)
    replies = stage(bl.answered(bl.each_block(blocks, _ask(window, by), bl.CELLS), by, _shared), "replies")
    known = bl.with_replies(blocks, replies)
    answers = bl.answered(bl.each_block(known, _ask_named(window, by), bl.CELLS), by, _smaller, NAMED)
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    return bl.each_block(known.join(by_block, "block", "left"), _remove(window, by), RESULT)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM win JOIN least USING (k) WHERE m < doc_id)),
places AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w),
each AS (SELECT t.doc_id, t.p, t.words[t.p] AS word, g.p IS NOT NULL AS off FROM places t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p),
runs AS (SELECT *, off AND NOT coalesce(lag(off) OVER (PARTITION BY doc_id ORDER BY p), false) AS rises FROM each),
sums AS (SELECT doc_id, count(*) FILTER (off) AS n_removed, count(*) FILTER (rises) AS n_spans, string_agg(word, ' ' ORDER BY p) FILTER (NOT off) AS kept FROM runs GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN sums USING (doc_id)
"""
