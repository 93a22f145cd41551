"""Removal of byte strings that occur twice, by column-wise suffix order over many documents.

The suffixes that matter are windows of ``LENGTH`` bytes. Each window has an anchor, the
smallest hash of a short string in it; equal windows have equal anchors in equal places, so
the collection falls into groups by anchor, and a group's texts are lined up on the anchor.
Rounds then go from the last column to the first: each inserts one symbol per text, sorts
the texts stably by it (the Burrows-Wheeler step) and updates the common prefixes of
neighbours. A window is repeated if, in the round of its first symbol, it shares ``LENGTH``
symbols with a neighbour.

What comes before the rounds, for groups of every size alike, leaves out what they need not see:

1. Runs of windows with one anchor are texts. Blocks ask which of their texts occur elsewhere
   and which anchors have different texts. A text that occurs twice is repeated in full; texts
   are told apart by 128 bits. An anchor with one text is done.
2. Of the other texts' windows, those whose 64-bit hash occurs once are unique. This only
   excludes.
3. Runs of what is left are sent as bytes. Equal ones meet first, spread by their contents so
   that a common passage is no hot key; one of each goes on to the rounds of its anchor.

The files of each step are those of Spark's shuffle, read in sequence.

Defined cases: a null text counts as empty; texts shorter than ``LENGTH`` keep all bytes; a
repeat may lie in the same document, overlaps included; repeated rows are documents of their
own, and repeat each other; null ids are kept; an empty table gives an empty result; further
columns are ignored. A single document is held in memory whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import blocks as bl
from weftgraph.llm.scratch import stage

LENGTH = 400
ANCHOR = 48
_U = np.uint64
_PLACE = _U(32)  #: bits of a place in a part; no text is longer
_ONE = _U(1)

#: Entries of the first question. Of texts: second hash and count; of anchors: smallest and largest text hash.
ABOUT = np.dtype([("x", np.uint64), ("y", np.uint64)])
SENT = "bucket long, block long, places binary, anchors binary, offs binary, runs binary, copies binary, text binary"
MET = "bucket long, blocks binary, places binary, anchors binary, offs binary, runs binary, text binary, whole array<struct<block:bigint,places:binary>>"
ANSWERS = "block long, whole binary, place int, bits binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    full = np.append(values, np.full(-len(values) % width, np.iinfo(np.uint64).max, _U)).reshape(-1, width)
    forth = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns sorted together."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    differs = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        differs |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(differs) + 1])


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), then the same for the next."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(size.sum())


class Anchored:
    """A part's windows in runs of one anchor, and the distinct texts of the runs."""

    def __init__(self, block: bl.Block, length: int, anchor: int):
        self.bytes, self.length, self.docs = block.bytes, length, (block.ids, block.begin, block.end)
        self.sums = bl.byte_sums(block.bytes)
        starts = np.concatenate([np.arange(i, j - length + 1) for i, j in zip(block.begin, block.end, strict=True) if j - i >= length] or [np.empty(0, np.int64)])
        short = self.sums.all(anchor)
        place = starts
        if len(starts):
            near = short >> _PLACE << _PLACE
            near |= np.arange(len(near), dtype=_U)
            place = (sliding_min(near, length - anchor + 1)[starts] & _U((1 << 32) - 1)).astype(np.int64)
            del near
        new = _heads(place)
        last = np.append(new[1:], len(place)) - 1
        self.begin, self.run, self.off = starts[new], (last - new + 1)[: len(new)], place[new] - starts[new]
        anchors = bl.mixed(short[place[new]]) | _ONE  # anchors are small hashes; mixed again, they fill all buckets alike
        del short, place, starts
        second = bl.byte_sums(block.bytes, bl.FACTORS[1])
        end = self.begin + self.run + length - 1
        mark = bl.mixed(self.off.astype(_U) ^ anchors)
        one, two = (self.sums.of(self.begin, end) ^ mark) & ~_ONE, second.of(self.begin, end) ^ mark
        order = np.lexsort((two, one))
        head = _heads(one[order], two[order])
        self.texts, self.seconds = one[order][head], two[order][head]  # distinct texts; first: a run of each
        self.first, self.counts = order[head], np.diff(np.append(head, len(order)))
        self.anchors = anchors[self.first]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.repeat(np.arange(len(head)), self.counts)


class Known:
    """A block's parts, its first question, and what was said to it."""

    def __init__(self, parts: bl.Parts, length: int, anchor: int):
        self.parts = [Anchored(p, length, anchor) for p in parts]
        texts, seconds, anchors, counts = (np.concatenate([getattr(w, n) for w in self.parts]) for n in ("texts", "seconds", "anchors", "counts"))
        order = np.lexsort((seconds, texts))
        head = _heads(texts[order], seconds[order])
        by_anchor = np.lexsort((texts, anchors))
        a_head = _heads(anchors[by_anchor])
        self.hashes = np.concatenate([texts[order][head], anchors[by_anchor][a_head]])
        self.extra = np.empty(len(self.hashes), ABOUT)
        t = len(head)
        self.extra["x"][:t] = seconds[order][head]
        self.extra["y"][:t] = np.minimum(np.add.reduceat(counts[order], head), 2) if t else 0
        self.extra["x"][t:] = texts[by_anchor][a_head]
        self.extra["y"][t:] = texts[by_anchor][np.append(a_head[1:], len(by_anchor)) - 1] if t else 0
        sort = np.lexsort((self.extra["x"], self.hashes))
        self.hashes, self.extra = self.hashes[sort], self.extra[sort]

    def hear(self, replies: list | None, by: bl.Cut) -> None:
        """Per part and distinct text: is it repeated in full, does its anchor have other texts."""
        said = bl.said_of(self.hashes, replies, by)
        anchors = (self.hashes & _ONE) > 0
        many = self.hashes[anchors & said]
        hashes, seconds = self.hashes[~anchors & said], self.extra["x"][~anchors & said]
        head = _heads(hashes)
        some, twins = hashes[head], len(head) < len(hashes)
        pairs = {(int(h), int(x)) for h, x in zip(hashes, seconds, strict=True)} if twins else set()  # two texts share a first hash
        for w in self.parts:
            at = np.minimum(np.searchsorted(some, w.texts), max(0, len(some) - 1))
            w.whole = (some[at] == w.texts) & (seconds[head][at] == w.seconds) if len(some) else np.zeros(len(w.texts), bool)
            if twins:
                w.whole = np.array([(int(h), int(x)) in pairs for h, x in zip(w.texts, w.seconds, strict=True)], bool)
            w.mixed = np.isin(w.anchors, many)


def _about(hashes: np.ndarray, _: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Of texts: whether they occur twice or more. Of anchors: whether they have different texts."""
    x, y = extra["x"], extra["y"]
    order = np.lexsort((x, hashes))
    h, x, y = hashes[order], x[order], y[order]
    text = (h & _ONE) == 0
    head = _heads(h, np.where(text, x, 0))
    size = np.diff(np.append(head, len(h)))
    total, low, high = np.add.reduceat(np.where(text, y, 0), head), np.minimum.reduceat(x, head), np.maximum.reduceat(y, head)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(np.where(text[head], total > 1, low != high), size)
    return out


def _ask(length: int, anchor: int, by: bl.Cut):
    def run(number: int, parts: bl.Parts, _: dict) -> Iterator[pa.RecordBatch]:
        known = Known(parts, length, anchor)
        yield bl.cells(number, known.hashes, known.extra, by)

    return run


class Counted:
    """Distinct hashes of the windows of texts whose anchors have others, and how often they occur, up to twice."""

    def __init__(self, known: Known):
        self.starts, self.windows, weights = [], [], [np.empty(0, np.int64)]
        for w in known.parts:
            chosen = np.flatnonzero(w.mixed)
            runs = w.first[chosen]
            starts = _spread(w.begin[runs], w.run[runs])
            self.starts.append(starts)
            self.windows.append(w.sums.of(starts, starts + w.length))
            weights.append(np.repeat(np.where(w.whole[chosen], 2, 1), w.run[runs]))
        self.hashes, which = np.unique(np.concatenate([np.empty(0, _U), *self.windows]), return_inverse=True)
        self.counts = np.minimum(np.bincount(which, weights=np.concatenate(weights), minlength=len(self.hashes)), 2).astype(np.uint8)
        self.which = np.split(which, np.cumsum([len(x) for x in self.windows])[:-1])


def _often(hashes: np.ndarray, _: np.ndarray, counts: np.ndarray) -> np.ndarray:
    _, which = np.unique(hashes, return_inverse=True)
    return np.bincount(which, weights=counts)[which] > 1


def _count(length: int, anchor: int, by: bl.Cut):
    def run(number: int, parts: bl.Parts, row: dict) -> Iterator[pa.RecordBatch]:
        known = Known(parts, length, anchor)
        known.hear(row["replies"], by)
        counted = Counted(known)
        yield bl.cells(number, counted.hashes, counted.counts, by)

    return run


class Pieces:
    """A block's distinct runs of windows that may repeat, in order of part and place; ``at`` lists where each part has which."""

    def __init__(self, known: Known, replies: list | None, by: bl.Cut):
        counted = Counted(known)
        often = bl.said_of(counted.hashes, replies, by) | (counted.counts > 1)
        places: dict[tuple, int] = {}
        self.rows, self.copies, self.at = [], [], []
        for w, starts, which in zip(known.parts, counted.starts, counted.which, strict=True):
            runs = w.first[np.flatnonzero(w.mixed)]
            some = often[which]
            owner = np.repeat(np.arange(len(runs)), w.run[runs])
            joined = some[1:] & some[:-1] & (owner[1:] == owner[:-1])
            head = np.flatnonzero(some & ~np.concatenate([[False], joined])) if len(some) else owner
            tail = np.flatnonzero(some & ~np.concatenate([joined, [False]])) if len(some) else owner
            own = runs[owner[head]]
            begin, size = starts[head], tail - head + 1
            anchors, offs = w.anchors[w.which[own]], w.off[own] - (begin - w.begin[own])
            data, here = w.bytes.tobytes(), []
            for b, n, anchor, off in zip(begin.tolist(), size.tolist(), anchors.tolist(), offs.tolist(), strict=True):
                piece = (anchor, off, data[b : b + n + w.length - 1])
                place = places.setdefault(piece, len(self.rows))
                if place == len(self.rows):
                    self.rows.append((*piece, n))
                    self.copies.append(0)
                self.copies[place] += 1
                here.append((b, n, place))
            self.at.append(here)


def _send(length: int, anchor: int, by: bl.Cut):
    def run(number: int, parts: bl.Parts, row: dict) -> Iterator[pa.RecordBatch]:
        known = Known(parts, length, anchor)
        known.hear(row["replies"], by)
        pieces = Pieces(known, row["counted"], by)
        keys = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big") for _, _, t, _ in pieces.rows], _U)
        order = np.argsort(keys, kind="stable")
        cut = bl.ranges(keys[order], by.bits)
        packs: list[list] = [[] for _ in range(6)]
        for _, c in cut:
            some = [pieces.rows[i] for i in order[c]]
            columns = (order[c].astype(np.uint32), np.array([x[0] for x in some], _U), np.array([x[1] for x in some], np.uint16), np.array([x[3] for x in some], np.uint16), np.minimum([pieces.copies[i] for i in order[c]], 2).astype(np.uint8))
            for pack, column in zip(packs, columns, strict=False):
                pack.append(bl.pack_array(column))
            packs[5].append(bl.packed(b"".join(x[2] for x in some)))
        names = ("places", "anchors", "offs", "runs", "copies", "text")
        yield bl.table({"bucket": ([b for b, _ in cut], pa.int64()), "block": ([number] * len(cut), pa.int64())} | {n: (p, pa.binary()) for n, p in zip(names, packs, strict=True)})

    return run


def _unpacked_texts(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Places, anchors, offsets, runs and texts, row after row."""
    kinds = {"places": np.uint32, "anchors": np.uint64, "offs": np.uint16, "runs": np.uint16}
    places, anchors, offs, runs = (np.concatenate([bl.unpack_array(x, kind) for x in rows[name]]).astype(np.uint64 if name == "anchors" else np.int64) for name, kind in kinds.items())
    data = b"".join(map(bl.unpacked, rows["text"]))
    end = np.cumsum(runs + length - 1)
    return places, anchors, offs, runs, [data[j - n : j] for j, n in zip(end.tolist(), (runs + length - 1).tolist(), strict=True)]


def _meet(length: int, by: bl.Cut):
    """Equal pieces, byte by byte: all of them are repeated; one of each goes on to its anchor's rounds."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        places, anchors, offs, runs, texts = _unpacked_texts(rows, length)
        counts = [bl.unpack_array(x, np.uint8) for x in rows["copies"]]
        blocks, copies = np.repeat(rows["block"].to_numpy(), [len(c) for c in counts]), np.concatenate(counts)
        groups: dict[tuple, list[int]] = {}
        for i, piece in enumerate(zip(anchors.tolist(), offs.tolist(), texts, strict=True)):
            groups.setdefault(piece, []).append(i)
        whole = np.zeros(len(texts), bool)
        for members in groups.values():
            whole[members] = len(members) > 1 or copies[members[0]] > 1
        # one of each goes on, without an owner if it is decided here
        one = np.array([m[0] for m in groups.values()])
        one = one[np.argsort(anchors[one], kind="stable")]
        owner = np.where(whole[one], -1, blocks[one])
        out = []
        for b, c in bl.ranges(anchors[one], by.bits):
            at = one[c]
            out.append((b, bl.pack_array(owner[c]), bl.pack_array(places[at].astype(np.uint32)), bl.pack_array(anchors[at]), bl.pack_array(offs[at].astype(np.uint16)), bl.pack_array(runs[at].astype(np.uint16)), bl.packed(b"".join(texts[i] for i in at)), None))
        told = [{"block": int(b), "places": bl.pack_array(places[whole & (blocks == b)].astype(np.uint32))} for b in np.unique(blocks[whole])]
        if told:
            out.append((None, *[None] * 6, told))
        names = ["bucket", "blocks", "places", "anchors", "offs", "runs", "text", "whole"]
        return pd.DataFrame(out, columns=names).astype({"bucket": "Int64"})

    return run


def repeated_windows(group: np.ndarray, off: np.ndarray, run: np.ndarray, text: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Whether each window of each text equals one of another text of its group.

    Texts come by group and are lined up on their anchors; the answer lists the windows of
    the first text, then of the second, and so on.
    """
    size = run + length - 1
    origin = np.cumsum(size) - size
    column = (length - anchor) - off  # of a text's first symbol
    answer, answer_at = np.zeros(int(run.sum()), bool), np.cumsum(run) - run
    order, common = np.arange(len(group)), np.zeros(len(group) + 1, np.int16)
    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) * 257
    for c in range(2 * length - anchor - 1, -1, -1):
        place = c - column[order]
        there = (place >= 0) & (place < size[order])
        symbol = np.where(there, text[np.where(there, origin[order] + place, 0)], 256).astype(np.int64)
        key = number[order] + symbol
        joined = common[1:-1] if len(order) > 1 else common[:0]
        if (key[1:] < key[:-1]).any():
            sort = np.argsort(key, kind="stable")
            before, after = sort[:-1], sort[1:]
            least = np.zeros(len(joined), np.int16)
            same = key[before] == key[after]
            step = same & (after == before + 1)
            least[step] = common[after[step]]
            far = np.flatnonzero(same & ~step)
            if len(far):
                pairs = np.column_stack([before[far] + 1, after[far] + 1]).ravel()
                least[far] = np.minimum.reduceat(common, pairs)[::2]
            order, key, symbol = order[sort], key[sort], symbol[sort]
        else:
            same, least = key[1:] == key[:-1], joined
        common[1:-1] = np.where(same & (symbol[1:] < 256), np.minimum(least + 1, length), 0)
        place = c - column[order]
        full = np.flatnonzero(((common[:-1] >= length) | (common[1:] >= length)) & (place >= 0) & (place < run[order]))
        answer[answer_at[order[full]] + place[full]] = True
    return answer


def _judge(length: int, anchor: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        places, anchors, offs, runs, texts = _unpacked_texts(rows, length)
        blocks = np.concatenate([bl.unpack_array(x, np.int64) for x in rows["blocks"]])
        order = np.argsort(anchors, kind="stable")
        found = repeated_windows(anchors[order], offs[order], runs[order], np.frombuffer(b"".join(texts[i] for i in order), np.uint8), length, anchor)
        end = np.cumsum(runs[order])
        out = [(int(blocks[i]), None, int(places[i]), bl.packed(np.packbits(found[j - runs[i] : j]).tobytes())) for i, j in zip(order.tolist(), end.tolist(), strict=True) if blocks[i] >= 0 and found[j - runs[i] : j].any()]
        return pd.DataFrame(out, columns=["block", "whole", "place", "bits"]).astype({"block": "int64", "place": "Int64"})

    return run


def _remove(length: int, anchor: int, by: bl.Cut):
    def run(number: int, parts: bl.Parts, row: dict) -> Iterator[pa.RecordBatch]:
        known = Known(parts, length, anchor)
        known.hear(row["replies"], by)
        pieces = Pieces(known, row["counted"], by)
        gone: list[np.ndarray | None] = [None] * len(pieces.rows)
        for r in row["answers"] or []:
            if r["whole"] is not None:
                for place in bl.unpack_array(r["whole"], np.uint32).tolist():
                    gone[place] = np.ones(pieces.rows[place][3], bool)
            else:
                gone[r["place"]] = np.unpackbits(np.frombuffer(bl.unpacked(r["bits"]), np.uint8), count=pieces.rows[r["place"]][3]).astype(bool)
        for w, here in zip(known.parts, pieces.at, strict=True):
            whole = np.flatnonzero(w.whole[w.which])
            begin, size = [w.begin[whole]], [w.run[whole]]
            for at, n, place in here:
                if (bits := gone[place]) is not None:
                    starts = np.array([at]) if bits.all() else at + np.flatnonzero(bits)
                    begin.append(starts)
                    size.append(np.array([n]) if bits.all() else np.ones(len(starts), np.int64))
            yield _result(w, np.concatenate(begin), np.concatenate(size))

    return run


def _result(w: Anchored, gone: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """The rows of a part of which the runs of ``size`` windows that start at ``gone`` are removed."""
    ids, begin, end = w.docs
    total = len(w.bytes)
    steps = np.bincount(gone, minlength=total + 1) - np.bincount(gone + size + w.length - 1, minlength=total + 1)
    off = np.cumsum(steps[:total]) > 0
    removed = np.concatenate([[0], np.cumsum(off)])
    rises = np.concatenate([[0], np.cumsum(off & ~np.concatenate([[False], off[:-1]]))])
    digest = [hashlib.sha256(w.bytes[i:j][~off[i:j]].tobytes()).hexdigest() for i, j in zip(begin, end, strict=True)]
    return bl.table({
        "doc_id": (ids, pa.int64()), "n_bytes": (end - begin, pa.int64()), "n_removed": (removed[end] - removed[begin], pa.int64()),
        "n_spans": (rises[end] - rises[begin], pa.int64()), "kept_sha256": (digest, pa.string()),
    })


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, bucket_bytes: int = bl.BUCKET_BYTES, fan: int = bl.FAN_BITS) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, digest of what is kept."""
    blocks = bl.make_blocks(docs, id_col, text_col, parts=1, bucketed=True)  # the arrays of one part are what a task has room for
    by = bl.bucket_cut(blocks, bucket_bytes, fan)
    replies = stage(bl.answered(bl.each_block(blocks, _ask(length, anchor, by), bl.CELLS), by, _about, ABOUT), "about")
    known = bl.with_replies(blocks, replies)
    counted = stage(bl.answered(bl.each_block(known, _count(length, anchor, by), bl.CELLS), by, _often, np.uint8), "counted")
    known = known.join(counted.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("counted")), "block", "left")
    met = bl.each_block(known, _send(length, anchor, by), SENT).groupBy("bucket").applyInPandas(_meet(length, by), MET)
    met = stage(met, "met")
    told = met.select(F.explode("whole").alias("w")).select(F.col("w.block").alias("block"), F.col("w.places").alias("whole"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("binary").alias("bits"))
    judged = met.where("bucket IS NOT NULL").groupBy("bucket").applyInPandas(_judge(length, anchor), ANSWERS)
    answers = told.unionByName(judged).groupBy("block").agg(F.collect_list(F.struct("whole", "place", "bits")).alias("answers"))
    return bl.each_block(known.join(answers, "block", "left"), _remove(length, anchor, by), RESULT)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
