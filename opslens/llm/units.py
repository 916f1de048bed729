"""Texts cut where no vocabulary joins over: the units that tokenizers can encode alone.

A unit is a space with all that follows it up to the next cut.  A cut lies before a space whose
neighbour is neither white space nor the sign that piece vocabularies write for a space, so
neither a pattern for words with their leading space nor a merge of pieces reaches over it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from opslens.llm.words import binary_array, numbered, text_bytes

#: The sign of piece vocabularies for a space.
SPACE_SIGN = "▁"


def _space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space or the space sign."""
    one = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    found = (one <= 32) & ((one >= 28) | ((one >= 9) & (one <= 13)))
    found |= (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    general = (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    general |= (two == 0x81) & (one == 0x9F)
    found |= (three == 0xE2) & (general | ((two == 0x96) & (one == 0x81)))
    found |= ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    return found


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, all other bytes take the characters from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units:
    """Units of a text column, with a space put before every text that is not empty.

    ``distinct``: the different units (large_binary); ``numbers``: the unit at each place;
    ``first``: each text's first place, with one more entry for the end.
    """

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        at = np.flatnonzero(data == 32)
        at = at[at > 0]
        edge[at[~_space_before(data, at)]] = True
        edge[-1] = True
        cuts = np.flatnonzero(edge)
        if not len(data):
            cuts = np.zeros(1, np.int64)
        self.numbers, self.distinct = numbered(binary_array(cuts, data))
        self.first = np.searchsorted(cuts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def cut(parts: pa.Array, units: Units) -> tuple[memoryview, np.ndarray]:
    """One binary value per distinct unit, laid out text after text: all bytes and each text's bounds."""
    data, marks = text_bytes_of(parts.take(pa.array(units.numbers)))
    return memoryview(data), marks[units.first]


def text_bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary array."""
    _, marks, data = values.buffers()
    offsets = np.frombuffer(marks, np.int64)[values.offset : values.offset + len(values) + 1] if marks else np.zeros(1, np.int64)
    if data is None:
        return np.empty(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_values(tokens: pa.Array, lengths: np.ndarray) -> pa.Array:
    """One binary value per unit: the joined values of its tokens."""
    data, marks = text_bytes_of(tokens)
    return binary_array(marks[np.concatenate([[0], np.cumsum(lengths)])], data)


def joined_sha256(data: memoryview, bounds: np.ndarray, tail: int = 1) -> list[str]:
    """SHA-256 of each text's bytes without the ``tail`` bytes after its last entry."""
    return [
        hashlib.sha256(data[a : max(a, b - tail)]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
    ]
