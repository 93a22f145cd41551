"""Words of many texts at once, as arrays.

A batch's texts lie one after another in one buffer; a table of 256 kinds says of every byte
whether it belongs to a word, parts words, or parts pieces of text as well. Words come out as
places in a dictionary of the slice, so that later steps count numbers instead of strings.
Kinds are of bytes, which suits every class of characters that is the same for all of 0x80 and up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at a time; a longer text is a slice of its own.
SLICE_BYTES = 12 << 20
WORD, GAP, STOP = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def kinds(gaps: bytes, stops: bytes = b"") -> np.ndarray:
    table = np.full(256, WORD, np.uint8)
    table[list(gaps)], table[list(stops)] = GAP, STOP
    return table


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """The rows again, in tables whose texts together have at most ``most`` bytes, or of one row."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                yield pa.Table.from_batches([*held, batch.slice(begin, i - begin)])
                held, size, begin = [], 0, i
            size += n
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


class Words:
    """The words of ``texts`` in order: ``code`` in ``distinct``, ``row`` of the text, ``next``: the following word is of the same piece."""

    def __init__(self, texts: pa.ChunkedArray, table: np.ndarray):
        texts = pc.fill_null(texts, "").combine_chunks().cast(pa.large_binary())
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
        starts = offsets[:-1] - offsets[0]
        kind = table[data]
        inside = kind == WORD
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        own = starts[starts < len(data)]
        begins[own] = inside[own]
        at = np.flatnonzero(begins)
        self.row = (np.searchsorted(starts, at, "right") - 1).astype(np.int32)
        piece = np.cumsum(kind == STOP, dtype=np.int32)[at]
        self.next = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        del piece, kind
        letters = LOWER[data[inside]]
        edges = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(letters)]).dictionary_encode()
        self.code, self.distinct = coded.indices.to_numpy(), coded.dictionary


def text_of(binary: pa.Array) -> pa.Array:
    """The same bytes as strings."""
    return pc.cast(binary, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
