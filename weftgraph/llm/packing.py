"""Packing token sequences: best-fit decreasing over windows of a fixed capacity.

Spark tokenises every document where its text lies and keeps a thin row per piece: a
document longer than the capacity is first cut into full windows, what remains is one piece.
Pieces are dealt to buckets of bounded size; within a bucket the longest piece goes first,
into the open window with the least room that still takes it. A segment tree indexed by
remaining capacity finds that window. Token ids never leave the task that made them.

Defined cases: a null text counts as empty and still yields its end id, a piece of one
token; pieces of equal length go by id, then start, a null id first; repeated rows are
packed as often as they stand; ids stay 64-bit numbers next to null ones; an empty table
gives an empty result; more columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.scratch import forget, give_back, remembers, stage

CAPACITY = 4096
END_ID = 2
BUCKET_PIECES = 50_000
#: Words whose ids a task remembers; beyond that it keeps those met again, or none if they are too many.
REMEMBERED = 600_000
#: Bytes of text that are taken apart at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_LETTERS, _OTHER = re.compile("[a-zß-öø-ÿ]+"), re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Printable ASCII that holds no special token, and the runs that the vocabulary splits it into.
_ASCII, _RUNS = re.compile("[!-;=-~]+"), re.compile("(?i)'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_GAPS, _SMALL, _MARKS = (np.isin(np.arange(256), list(some)) for some in (b"\x20\x09\x0a\x0b\x0c\x0d", bytes(range(97, 123)), b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"))

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long, kind string"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """How many words come before each text (and in all), every word's place among the distinct ones, and these.

    Words end at white space and where a mark follows a small letter.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    gap, letter = _GAPS[data], _SMALL[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] != 0xB7)  # ß to ÿ without the sign of division
    begins = ~gap
    begins[1:] &= gap[:-1] | (_MARKS[data[1:]] & letter[:-1])
    sizes = np.array([len(t) + 1 for t in texts])
    before = np.searchsorted(np.flatnonzero(begins), np.concatenate([[0], np.cumsum(sizes)]))
    letters = data[~gap]
    edges = np.append(np.flatnonzero(begins[~gap]), len(letters)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(letters)]).dictionary_encode()
    return before, coded.indices.to_numpy(), coded.dictionary.to_pylist()


class WordIds:
    """Token ids by word, as little-endian bytes.

    The vocabulary's own splitting ends every token at white space and at the end of every run
    of letters, so the ids of a text are those of its words one after another. A run of letters
    is a token sequence of its own that ends in a token marked as the end of a word, so many
    runs can be encoded as one text and told apart again. Texts of Latin letters alone are
    lowered beforehand, as the vocabulary would; others are split at white space only.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.again = Tokenizer.from_file(vocabulary), {}, set()
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> None:
        self.known.update((w.encode(), ids.tobytes()) for w, ids in zip(words, self._ids(words), strict=True))

    def _together(self, words: list[str], runs: list[int]) -> None:
        """Learns ``words`` that hold the given numbers of token runs, encoded in few texts."""
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = self._ids([" ".join(some)])[0]
            ends, last = 4 * (np.flatnonzero(self.ends[ids]) + 1), np.cumsum(runs[at : at + 1000])
            if len(ends) == last[-1]:
                data, cuts = ids.tobytes(), [0, *ends[last - 1].tolist()]
                self.known.update((w.encode(), data[i:j]) for w, i, j in zip(some, cuts, cuts[1:], strict=False))
            else:
                self._apart(some)

    def _learn(self, distinct: list[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in self.again} if len(self.again) < REMEMBERED // 2 else {}
            self.again = set()
        new = [w for w in distinct if w not in self.known]
        self.again.update(set(distinct).difference(new))
        new = [w.decode() for w in new]
        letters = [w for w in new if _LETTERS.fullmatch(w)]
        self._together(letters, [1] * len(letters))
        rest = set(new).difference(letters)
        plain = [w for w in rest if _ASCII.fullmatch(w)]
        self._together(plain, [len(_RUNS.findall(w)) for w in plain])
        self._apart(list(rest.difference(plain)))

    def _slice(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of some texts of Latin letters."""
        before, code, distinct = _words(texts)
        self._learn(distinct)
        known = [self.known[w] for w in distinct]
        ids, n = np.frombuffer(b"".join(known), "<u4"), np.array([len(x) // 4 for x in known], np.int64)
        first, size = (np.cumsum(n) - n)[code], n[code]
        end = np.cumsum(size)
        data = ids[np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        cuts = (4 * np.concatenate([[0], end])[before]).tolist()
        return (data[i:j] for i, j in zip(cuts, cuts[1:], strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        out, held, size = [b""] * len(texts), [], 0

        def settle() -> None:
            for i, ids in zip([i for i, _ in held], self._slice([t for _, t in held]), strict=True):
                out[i] = ids
            held.clear()

        for i, text in enumerate(texts):
            if _OTHER.search(text):
                words = [w.encode() for w in _GAP.split(text) if w]
                self._learn(list(set(words)))
                out[i] = b"".join(map(self.known.__getitem__, words))
                continue
            data = text.lower().encode()
            if held and size + len(data) > SLICE_BYTES:
                settle()
                size = 0
            held.append((i, data))
            size += len(data)
        settle()
        return out


@lru_cache(1)
def encoder_of(vocabulary: str) -> WordIds:
    """A worker's encoder, which later tasks find as earlier ones left it."""
    return WordIds(vocabulary)


remembers("packing", encoder_of.cache_clear)


def _cut(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        forget("packing")
        encoder, deal = encoder_of(vocabulary), TaskContext.get().partitionId() * 7919
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal", "kind")
        for batch in batches:
            ids, texts, kinds = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            out: list[tuple] = []
            for at in range(0, len(ids), 1024):
                some = [t or "" for t in texts.slice(at, 1024).to_pylist()]
                for doc, data, kind in zip(ids[at : at + 1024], encoder.encode(some), kinds[at : at + 1024], strict=True):
                    data += end_id.to_bytes(4, "little")
                    total = len(data) // 4
                    for start in range(0, total, capacity):
                        piece = data[4 * start : 4 * (start + capacity)]
                        deal += 1
                        out.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, deal, kind))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=list(names))
            give_back()

    return run


class RoomTree:
    """Open windows by remaining room; finds the least room of at least some size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += by
            at >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.windows[room].append(window)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and window of the tightest fit, which leaves the tree; None if none fits."""
        at = need + self.leaves
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Window and offset of each of ``lengths``, which fall."""
    tree, windows, out = RoomTree(capacity), 0, []
    for need in lengths:
        if (found := tree.take(need)) is None:
            found, windows = (capacity, windows), windows + 1
        room, window = found
        out.append((window, capacity - room))
        tree.put(room - need, window)
    return out


def _pack(capacity: int):
    order = [("kind", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
        sequence, offset, first = [], [], key[0].as_py() << 32
        for _, some in groupby(zip(rows.column("kind").to_pylist(), rows.column("length").to_pylist(), strict=True), itemgetter(0)):
            placed = best_fit([length for _, length in some], capacity)
            sequence += [first + w for w, _ in placed]
            offset += [o for _, o in placed]
            first = max(sequence[-len(placed) :]) + 1
        return rows.select(columns).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, bucket_pieces: int = BUCKET_PIECES, apart_col: str | None = None) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence.

    Documents that differ in ``apart_col``, where one is named, share no sequence.
    """
    kind = (F.col(apart_col) if apart_col else F.lit(None)).cast("string").alias("kind")
    pieces = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), kind).mapInArrow(_cut(vocabulary, capacity, end_id), PIECES), "pieces")
    buckets = max(1, -(-pieces.count() // bucket_pieces))
    return pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "deal"), F.lit(buckets))).groupBy("bucket").applyInArrow(_pack(capacity), PACKED)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
