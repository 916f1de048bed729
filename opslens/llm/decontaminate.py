"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A region of a document within ``k`` edits of an item of ``m`` bytes shares at least
``m - q + 1 - k*q`` q-grams with it, all on ``k + 1`` neighbouring diagonals (place in the
document minus place in the item).  Shared q-grams are therefore counted in bands of
diagonals that overlap by ``k``, bands that reach the bound are kept, and each is verified by
an alignment inside the band.  Nothing within the edit budget is lost.

Texts are compared as UTF-8 bytes with Latin letters in lower case and white space runs as
one space.  The benchmark is taken in blocks of at most ``BLOCK_BYTES``, one broadcast index a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.words import LOWER, SPACE, pieces, text_bytes

Q = 8
#: Edits allowed, as a share of an item's bytes.
EDITS = 0.1
#: Shared q-grams that a band must have at least; a short item gets fewer edits.
LEAST_SHARED = 4
BLOCK_BYTES = 2 << 20
FILTER_BITS = 22
_FAR = 1 << 40
_LOW = 24  # bits that carry the start beside the cost


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Comparable bytes, offsets of the texts among them, and the place each byte came from."""
    space = SPACE[data]
    out = np.where(space, np.uint8(32), LOWER[data])
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
    out[upper + 1] += 32  # Latin-1 capitals
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    kept = np.flatnonzero(~again)
    return out[kept], np.searchsorted(kept, offsets), kept


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q-gram that starts at each byte, as a number."""
    count = len(data) - q + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.ndarray((count,), "<u8", padded, strides=(1,))
    return windows & np.uint64((1 << 8 * q) - 1)


def _slot(gram: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


@dataclass
class Index:
    """q-grams of a block of items."""

    q: int
    ids: list
    data: np.ndarray  # comparable bytes of all items
    offsets: np.ndarray
    budget: np.ndarray  # edits per item
    least: np.ndarray  # shared q-grams per item
    shift: np.ndarray  # log2 of the band step per item
    keys: np.ndarray  # sorted distinct q-grams
    marks: np.ndarray  # postings of keys[i]: marks[i] to marks[i + 1]
    items: np.ndarray
    places: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: list[str], q: int = Q, edits: float = EDITS) -> Index:
        column = pa.array(texts, pa.large_string())
        data, offsets, _ = normal(*text_bytes(column))
        # blanks at the ends of an item say nothing
        size = np.diff(offsets)
        budget = np.floor(size * edits).astype(np.int64)
        budget = np.maximum(np.minimum(budget, (size - q + 1 - LEAST_SHARED) // q), 0)
        least = np.maximum(size - q + 1 - budget * q, 1)
        shift = np.ceil(np.log2(budget + 1)).astype(np.int64)
        gram = grams(data, q)
        owner = np.repeat(np.arange(len(ids)), size)[: len(gram)]
        place = np.arange(len(gram))
        whole = place + q <= offsets[owner + 1]
        gram, owner, place = gram[whole], owner[whole], (place - offsets[owner])[whole]
        order = np.argsort(gram, kind="stable")
        keys, first = np.unique(gram[order], return_index=True)
        return cls(
            q, ids, data, offsets, budget, least, shift, keys, np.append(first, len(gram)), owner[order], place[order]
        )

    def filter(self) -> np.ndarray:
        table = np.zeros(1 << FILTER_BITS, bool)
        table[_slot(self.keys)] = True
        return table


def _bands(index: Index, table: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Bands with enough shared q-grams: item, first diagonal of the band."""
    gram = grams(data, index.q)
    maybe = np.flatnonzero(table[_slot(gram)])
    where = np.searchsorted(index.keys, gram[maybe])
    hit = (where < len(index.keys)) & (index.keys[np.minimum(where, len(index.keys) - 1)] == gram[maybe])
    maybe, where = maybe[hit], where[hit]
    text = np.searchsorted(offsets, maybe, "right") - 1
    inside = maybe + index.q <= offsets[text + 1]
    maybe, where = maybe[inside], where[inside]
    count = index.marks[where + 1] - index.marks[where]
    upto = np.cumsum(count)
    posting = np.repeat(index.marks[where] - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)
    item = index.items[posting]
    diagonal = np.repeat(maybe, count) - index.places[posting] + _BASE
    step = index.shift[item]
    band = diagonal >> step
    also = np.flatnonzero(diagonal - (band << step) < index.budget[item])
    item = np.concatenate([item, item[also]])
    band = np.concatenate([band, band[also] - 1])
    key = np.sort(item * _SPAN + band)
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    shared = np.diff(np.append(edge, len(key)))
    item, band = np.divmod(key[edge], _SPAN)
    enough = shared >= index.least[item]
    item, band = item[enough], band[enough]
    return item, (band << index.shift[item]) - _BASE


_BASE = 1 << 31  # keeps diagonals positive
_SPAN = 1 << 36


def align(items: list[np.ndarray], texts: list[np.ndarray], widths: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """Least edits of each whole item inside its text, over start diagonals 0 to width - 1.

    Column d of row i stands for i bytes of the item and i + d of the text; start and end are free.
    All pairs go through the rows together; one that is over its budget everywhere is given up.
    Returns rows of cost, start and end in the text; a cost beyond the budget may be any such number.
    """
    lengths = np.array([len(i) for i in items])
    width, rows = int(widths.max()), int(lengths.max())
    text = np.full((len(items), rows + width + 1), 256, np.int16)
    item = np.full((len(items), rows), 257, np.int16)
    for n, (a, b) in enumerate(zip(items, texts)):
        item[n, : len(a)] = a
        text[n, : min(len(b), rows + width + 1)] = b[: rows + width + 1]
    one = 1 << _LOW
    column = np.arange(width, dtype=np.int64)
    cell = np.where(column < widths[:, None], column, _FAR)
    best = np.full((len(items), 3), _FAR)
    pair = np.arange(len(items))
    for i in range(rows):
        here = cell + (text[:, i : i + width] != item[:, i : i + 1]) * one
        np.minimum(here[:, :-1], cell[:, 1:] + one, out=here[:, :-1])
        here -= column * one
        np.minimum.accumulate(here, axis=1, out=here)
        cell = here + column * one
        done = np.flatnonzero(lengths[pair] == i + 1)
        if len(done):
            end = cell[done].argmin(axis=1)
            least = cell[done, end]
            best[pair[done]] = np.stack([least >> _LOW, least & (one - 1), end + i + 1], axis=1)
        if i % 16 == 15 or len(done):
            going = ((cell.min(axis=1) >> _LOW) <= budget[pair]) & (lengths[pair] > i + 1)
            if not going.all():
                cell, text, item, pair = cell[going], text[going], item[going], pair[going]
                if not len(pair):
                    break
    return best


def find(index: Index, table: np.ndarray, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """Regions of the texts within the budget: row, item, start, end (code points), edits.

    Regions of one item in one text never overlap: the one with the fewest edits stays.
    """
    raw, raw_offsets = text_bytes(column)
    data, offsets, source = normal(raw, raw_offsets)
    if not len(data) or not len(index.keys):
        return []
    item, low = _bands(index, table, data, offsets)
    order = np.argsort(np.diff(index.offsets)[item], kind="stable")  # pairs of like size together
    item, low = item[order], low[order]
    found = []
    for start in range(0, len(item), 64):
        part = slice(start, start + 64)
        k = index.budget[item[part]]
        first = low[part] - k
        width = (1 << index.shift[item[part]]) + 3 * k + 1
        middle = low[part] + (index.offsets[item[part] + 1] - index.offsets[item[part]]) // 2
        text = np.searchsorted(offsets, np.clip(middle, 0, len(data) - 1), "right") - 1
        items = [index.data[index.offsets[i] : index.offsets[i + 1]] for i in item[part]]
        texts = []
        for f, t, w, i in zip(first, text, width, items):
            end = min(f + len(i) + w + 1, offsets[t + 1])
            ahead = max(offsets[t] - f, 0)
            texts.append(np.concatenate([np.full(ahead, 256, np.int16), data[max(f, offsets[t]) : max(end, f)].astype(np.int16)]))
        cost, begin, stop = align(items, texts, width, k).T
        good = np.flatnonzero(cost <= k)
        found += [
            (int(cost[g]), int(text[g]), int(item[part][g]), int(max(first[g] + begin[g], offsets[text[g]])), int(min(first[g] + stop[g], offsets[text[g] + 1])))
            for g in good
        ]
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    out = []
    for cost, text, item_, begin, stop in sorted(set(found)):
        taken = chosen.setdefault((text, item_), [])
        if stop > begin and not any(begin < b and a < stop for a, b in taken):
            taken.append((begin, stop))
            at = lead[raw_offsets[text]]
            out.append((text, item_, int(lead[source[begin]] - at), int(lead[source[stop - 1] + 1] - at), cost))
    return sorted(out)


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about ``limit`` bytes; null texts and those under ``Q`` bytes name nothing to find."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.octet_length(F.trim("text")) >= Q)
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        text = row["text"].strip()
        if size + len(text.encode()) > limit and ids:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(text)
        size += len(text.encode())
    if ids:
        yield ids, texts


def _matches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        table = index.filter()
        for batch in pieces(batches, "text"):
            rows = find(index, table, batch.column("text"))
            if rows:
                text, item, start, end, edits = map(list, zip(*rows))
                sizes = np.diff(index.offsets)[item]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(text)),
                        pa.array([index.ids[i] for i in item], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(end, pa.int64()),
                        pa.array(edits, pa.int64()),
                        pa.array(sizes, pa.int64()),
                    ],
                    ["doc_id", "item_id", "start", "end", "edits", "item_bytes"],
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """Every region of a document that an item stands in: ``doc_id, item_id, start, end, edits, item_bytes``.

    Places are code points.  Null and empty texts match nothing; repeated rows report each for itself; equal
    items are reported under each id; an empty table on either side gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, start bigint, end bigint, edits bigint, item_bytes bigint"
    out = None
    for ids, texts in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Index.build(ids, texts, q, edits))
        found = rows.mapInArrow(_matches(sent), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


#: Text bytes searched at once where whole rows are held beside them.
CLEAN_BYTES = 1 << 20


def _clean(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        table = index.filter()
        for batch in pieces(batches, "__text", CLEAN_BYTES):
            kept = np.ones(batch.num_rows, bool)
            kept[[row[0] for row in find(index, table, batch.column("__text"))]] = False
            yield batch.drop_columns(["__text"]).filter(pa.array(kept))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """The documents without any such region, with all their columns; nothing is shuffled.

    Null and empty texts stay; repeated rows are judged alike; columns of any name pass through; an empty
    table stays empty, and an empty benchmark removes nothing.
    """
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    schema = out.schema
    for ids, texts in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Index.build(ids, texts, q, edits))
        text = F.col(names["text"]).cast("string").alias("__text")
        out = out.select("*", text).mapInArrow(_clean(sent), schema)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
