"""Documents in compressed blocks, and questions about hashed windows of them.

Counting every window of a corpus as a row of its own would shuffle many times the text.
Here a row holds a block of documents in a few parts, so that a task hashes their windows as
arrays, part by part. A block sends its sorted distinct hashes in cells, packed, one for each
range of hashes; a bucket's task sees all hashes of its range once and answers each block
with a few bits a hash. Blocks and buckets are of bounded size, whatever the corpus: a window
that occurs in a third of all documents is one hash per block. A block sends at most
``1 << FAN_BITS`` cells; where more buckets are needed, cells of one range meet and are cut
further, so rows grow with the text and not with blocks times buckets. The blocks are written
to the shared folder, so that all passes see the same documents in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.scratch import forget, give_back, remembers, stage, stage_by

PART_BYTES = 3 << 19
PART_DOCS = 4096
#: Parts that share a block's cells.
PARTS = 3
#: Bytes of text whose windows meet in one bucket.
BUCKET_BYTES = 6 << 20
#: Packed bytes of cells that are cut further at a time.
CUT_BYTES = 32 << 20
#: Of the ranges that one pass cuts hashes into; more take further passes.
FAN_BITS = 10
BLOCKS = "block long, parts array<struct<ids:array<bigint>,sizes:array<int>,data:binary>>, bytes long"
CELLS = "bucket long, blocks array<long>, tags binary, hashes binary, extra binary"
REPLIES = "block long, bucket long, bits binary"

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Two independent hashes of 64 bits; both together name a window.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


_PART = pa.struct([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])


def _pack_docs(batches: Iterator[pa.RecordBatch], most_parts: int = PARTS) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, parts, ids, texts = TaskContext.get().partitionId() << 32, [], [], []
    held = total = 0

    def part() -> dict:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        data = b"\n".join(texts[i] for i in order) + b"\n"
        return {"ids": [ids[i] for i in order], "sizes": [len(texts[i]) for i in order], "data": packed(data)}

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = (t.as_py() or "").encode()
            ids.append(i)
            texts.append(text)
            held += len(text) + 1
            if held >= PART_BYTES or len(ids) >= PART_DOCS:
                parts.append(part())
                total, held, ids, texts = total + held, 0, [], []
                if len(parts) == most_parts:
                    yield table({"block": ([number], pa.int64()), "parts": ([parts], pa.list_(_PART)), "bytes": ([total], pa.int64())})
                    number, parts, total = number + 1, [], 0
    if ids:
        parts.append(part())
    if parts:
        yield table({"block": ([number], pa.int64()), "parts": ([parts], pa.list_(_PART)), "bytes": ([total + held], pa.int64())})
    give_back()


def make_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, bucketed: bool = False) -> DataFrame:
    """Written blocks of the whole texts; a null text is empty, and null ids come last.

    ``bucketed`` blocks are shuffled once, here, and not in each of the joins with what was said to them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return (stage_by if bucketed else stage)(rows.mapInArrow(lambda batches: _pack_docs(batches, parts), BLOCKS), "blocks", *["block"] * bucketed)


class Block:
    """One part of a block as arrays: its bytes, and where documents begin and end."""

    def __init__(self, ids: list, sizes: list, data: bytes):
        self.ids, self.raw = ids, unpacked(data)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        sizes = np.array(sizes, np.int64)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.begin + sizes

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of every word, and the number of words before each document (and in all)."""
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[::2], edge[1::2]
        return begin, end, np.concatenate([np.searchsorted(begin, self.begin), [len(begin)]])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(2)
def _powers(least: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """The factor's powers and those of its inverse, modulo 2**64."""
    out = []
    for f in (factor, pow(factor, -1, 1 << 64)):
        p = np.full(least, f, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


remembers("blocks", _powers.cache_clear)


def powers(n: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers; those for the usual part are kept, those for a very long document are not."""
    if n <= PART_BYTES + (1 << 18):
        return _powers(PART_BYTES + (1 << 18), factor)
    return _powers.__wrapped__(int(n), factor)


class Sums:
    """Running sums of values times powers, from which any span's hash follows."""

    def __init__(self, values: np.ndarray, factor: int = FACTORS[0]):
        up, self.down = powers(len(values) + 1, factor)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * up[: len(values)], dtype=_U)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The polynomial hash of each span, wherever it lies, mixed with its length."""
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(_U) * _U(0xD6E8FEB86659FD93))


    def all(self, width: int) -> np.ndarray:
        """The hash of every span of ``width``, as ``of`` gives it."""
        n = max(0, len(self.sums) - width)
        out = self.sums[width:] - self.sums[:n]
        out *= self.down[:n]
        out += _U(width * 0xD6E8FEB86659FD93 % (1 << 64))
        return mixed(out)


_BYTE_VALUES = {f: mixed(np.arange(1, 257, dtype=_U) * _U(f)) for f in FACTORS}


def byte_sums(data: np.ndarray, factor: int = FACTORS[0]) -> Sums:
    return Sums(_BYTE_VALUES[factor][data], factor)


# --- numbers in few bytes -----------------------------------------------------------------


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as differences, byte by byte of all, compressed."""
    gaps = np.diff(values, prepend=_U(0))
    return packed(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpacked(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel(), dtype=_U)


def pack_array(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    return packed(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T).tobytes())


def unpack_array(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(unpacked(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


class Cut(NamedTuple):
    """Buckets are the ranges of a hash's upper ``bits`` bits; one pass cuts by ``fan`` of them at most."""

    bits: int
    fan: int = FAN_BITS


def bucket_cut(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN_BITS) -> Cut:
    """Each bucket sees the windows of a bounded amount of text."""
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return Cut(max(0, (-(-total // bucket_bytes) - 1).bit_length()), fan)


def ranges(hashes: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """The buckets that sorted ``hashes`` fall in, and the slice of each."""
    if not len(hashes):
        return []
    bucket = hashes >> _U(64 - bits) if bits else np.zeros(len(hashes), _U)
    head = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(hashes)]])
    return [(int(bucket[i]), slice(int(i), int(j))) for i, j in zip(head, head[1:], strict=False)]


def table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


class Parts:
    """The parts of one block, unpacked one at a time, as often as they are read."""

    def __init__(self, rows: list[dict]):
        self.rows = rows

    def __iter__(self) -> Iterator[Block]:
        for r in self.rows:
            yield Block(r["ids"], r["sizes"], r["data"])


def each_block(blocks: DataFrame, run: Callable[[int, Parts, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` on every block; gets its number, its parts, and the row's further columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("blocks")
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
                yield from run(row["block"], Parts(row.pop("parts")), row)
                give_back()

    return blocks.mapInArrow(rows, schema)


def with_replies(blocks: DataFrame, replies: DataFrame, name: str = "replies") -> DataFrame:
    """Blocks with their replies, an array of structs (null if there are none)."""
    columns = [c for c in replies.columns if c != "block"]
    by_block = replies.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))
    return blocks.join(by_block, "block", "left")


# --- cells: a block's hashes of one bucket --------------------------------------------------


def cells(number: int, hashes: np.ndarray, extra: np.ndarray | None, by: Cut) -> pa.RecordBatch:
    """The cells of a block's sorted ``hashes``; ``extra`` has an entry for each of them."""
    cut = ranges(hashes, min(by))
    return table({
        "bucket": ([b for b, _ in cut], pa.int64()), "blocks": ([[number]] * len(cut), pa.list_(pa.int64())), "tags": ([b""] * len(cut), pa.binary()),
        "hashes": ([pack_sorted(hashes[c]) for _, c in cut], pa.binary()), "extra": ([b"" if extra is None else pack_array(extra[c]) for _, c in cut], pa.binary()),
    })


def _opened(rows: list[dict], dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes, block numbers and extras of some cells, cell after cell."""
    hashes = [unpack_sorted(r["hashes"]) for r in rows]
    owners = [np.array(r["blocks"], np.int64)[unpack_array(r["tags"], np.uint32) if r["tags"] else np.zeros(len(h), np.int64)] for r, h in zip(rows, hashes, strict=True)]
    return np.concatenate(hashes), np.concatenate(owners), None if dtype is None else np.concatenate([unpack_array(r["extra"], dtype) for r in rows])


def _cut_further(bits: int, dtype):
    """Cells of a partition, in order of bucket, cut into ranges of ``bits`` bits."""

    def emit(rows: list[dict]) -> pa.RecordBatch:
        hashes, owners, extra = _opened(rows, dtype)
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        out = []
        for b, c in ranges(hashes, bits):
            blocks, tags = np.unique(owners[c], return_inverse=True)
            out.append((b, blocks.tolist(), pack_array(tags.astype(np.uint32)), pack_sorted(hashes[c]), b"" if extra is None else pack_array(extra[order][c])))
        types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        return table({n: ([o[i] for o in out], t) for i, (n, t) in enumerate(zip(("bucket", "blocks", "tags", "hashes", "extra"), types, strict=True))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["bucket"] != held[0]["bucket"] or size > CUT_BYTES):
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["hashes"]) + len(row["extra"])
        if held:
            yield emit(held)
        give_back()

    return run


def answered(asked: DataFrame, by: Cut, judge: Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray], dtype=None) -> DataFrame:
    """Replies to cells: what ``judge`` says of every entry of a bucket, as booleans or numbers.

    ``judge`` gets the bucket's hashes, block numbers and extras. A reply lists what was said of a
    block's entries in the bucket, by hash, then by extra; where all of it is false or zero there is none.
    """
    reached = by.fan
    while reached < by.bits:
        reached = min(by.bits, reached + by.fan)
        asked = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_cut_further(reached, dtype), CELLS)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes, owners, extra = _opened(rows.to_dict("records"), dtype)
        said = judge(hashes, owners, extra)
        fields = () if extra is None or extra.dtype.names is None else (extra[extra.dtype.names[0]],)
        order = np.lexsort((*fields, hashes, owners))
        owners, said = owners[order], said[order]
        head = np.concatenate([[0], np.flatnonzero(owners[1:] != owners[:-1]) + 1, [len(owners)]])
        out = [(int(owners[i]), said[i:j]) for i, j in zip(head, head[1:], strict=False) if said[i:j].any()]
        pack = (lambda x: packed(np.packbits(x).tobytes())) if said.dtype == bool else pack_array
        return pd.DataFrame({"block": [b for b, _ in out], "bucket": key[0], "bits": [pack(x) for _, x in out]}).astype({"block": "int64", "bucket": "int64"})

    return asked.groupBy("bucket").applyInPandas(run, REPLIES)


def said_of(hashes: np.ndarray, replies: list[dict] | None, by: Cut, dtype=bool) -> np.ndarray:
    """What the replies say of a block's sorted ``hashes``."""
    out = np.zeros(len(hashes), dtype)
    if not replies:
        return out
    bucket = np.array([r["bucket"] for r in replies], _U)
    shift = _U(64 - by.bits) if by.bits else _U(0)
    low, last = bucket << shift, (bucket << shift) | _U((1 << (64 - by.bits)) - 1)
    begin, end = np.searchsorted(hashes, low), np.searchsorted(hashes, last, "right")
    for r, i, j in zip(replies, begin.tolist(), end.tolist(), strict=True):
        out[i:j] = np.unpackbits(np.frombuffer(unpacked(r["bits"]), np.uint8), count=j - i) if dtype is bool else unpack_array(r["bits"], dtype)
    return out
