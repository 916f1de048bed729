"""Vectorised access to text columns inside Arrow tasks.

A *word* is a run of bytes other than space and ``\\t\\n\\v\\f\\r``; all helpers work
on the UTF-8 bytes of whole columns, never on one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes handled at once; a longer text makes a piece of its own.
PIECE_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the ``len + 1`` offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, marks, data = column.buffers()
    offsets = np.frombuffer(marks, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, in their order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))])
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def binary_array(offsets: np.ndarray, data: np.ndarray, kind=None) -> pa.Array:
    return pa.Array.from_buffers(
        kind or pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def _runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; no run crosses a bound."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    full = inside[cuts[:-1]]
    return cuts[:-1][full], cuts[1:][full]


class Words:
    """Words of a text column.

    ``values``: the words (large_binary); ``first``: index of each text's first word,
    with one more entry for the end; ``starts``/``ends``: their byte places.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = text_bytes(column)
        self.data = data
        inside = ~SPACE[data]
        self.starts, self.ends = _runs(inside, self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)
        body = data[inside]
        self.marks = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        self.values = binary_array(self.marks, LOWER[body] if lower else body)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words, and the distinct words."""
        return numbered(self.values)


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense numbers of the values, and the values they stand for."""
    coded = values.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dense numbers of pairs of non-negative numbers."""
    base = int(right.max(initial=0)) + 1
    return numbered(pa.array(left.astype(np.int64) * base + right))[0]


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per text, whose parts start at ``first``."""
    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a (large) binary array."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


def row_bytes(column: pa.Array) -> np.ndarray:
    return np.diff(text_bytes(column)[1])
