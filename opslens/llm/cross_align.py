"""Alignment of two tokenizers by interval coalescing, with corpus-wide counts of linked ids.

Tokens of both vocabularies are byte intervals.  Sorted by start, a running maximum of their
ends shows where both vocabularies end a token: there a group ends.  Within groups, tokens that
overlap are linked.  Texts are cut into units that neither vocabulary joins over (``units``), so
each distinct unit of a chunk is aligned once.  The first pass writes one row per chunk with its
distinct links; their counts over all documents come back to the chunks that hold them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm import units as U
from opslens.llm.collocations import expand, grouped, squeeze
from opslens.llm.piece_merge import PieceEncoder
from opslens.llm.shared import written
from opslens.llm.words import binary_array, totals

#: Text bytes of a chunk; a longer text makes a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Bytes of units that the byte-level tokenizer gets at once.
JOINED_BYTES = 1 << 16
#: Distinct units aligned at once.
UNITS = 1 << 15
#: Links that are counted per document at once.
SLICE_LINKS = 1 << 19


class ByteEncoder:
    """A byte-level vocabulary of the tokenizers library; special tokens in texts are plain text."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        rules = json.loads(vocabulary)
        if rules["normalizer"] or rules["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a byte-level vocabulary with the usual pattern")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        symbols = U.byte_symbols()
        octets = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            octets[number] = bytes(symbols[c] for c in token)
        self.octets = pa.array(octets, pa.large_binary())
        self.lengths = np.array([len(o) for o in octets])

    def encode_units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units and how many each has.  Units that end in white space would run
        into the next one and are encoded alone; the others are joined."""
        data, marks = U.text_bytes_of(distinct)
        if not len(distinct):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        alone = U._space_before(np.concatenate([data, [0]]), marks[1:])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.flatnonzero(alone)
        if len(single):
            texts = [distinct[int(i)].as_py().decode() for i in single]
            ids = [np.array(e.ids, np.int64) for e in self._encode(texts)]
            found.append((single, np.concatenate(ids), np.array([len(i) for i in ids])))
        rows = np.flatnonzero(~alone)
        block = (np.cumsum(np.diff(marks)[rows]) // JOINED_BYTES).astype(np.int64)
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(rows)]])
        parts = [rows[a:b] for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
        joined = [distinct.take(pa.array(p)) for p in parts]
        for part, values in zip(parts, joined):
            octets, ends = U.text_bytes_of(values)
            ids = np.array(self._encode([octets.tobytes().decode()])[0].ids, np.int64)
            upto = np.cumsum(self.lengths[ids])
            at = np.searchsorted(upto, ends[1:])
            if (upto[at] != ends[1:]).any():
                raise ValueError("a token spans two units")
            found.append((part, ids, np.diff(np.concatenate([[-1], at]))))
        lengths = np.zeros(len(distinct), np.int64)
        order = np.concatenate([f[0] for f in found])
        lengths[order] = np.concatenate([f[2] for f in found])
        values = U.split_values(
            binary_array(np.arange(sum(len(f[1]) for f in found) + 1) * 8, np.concatenate([f[1] for f in found]).view(np.uint8)),
            np.concatenate([f[2] for f in found]),
        ).take(pa.array(np.argsort(order)))
        return np.frombuffer(U.text_bytes_of(values)[0].tobytes(), np.int64), lengths

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


def coalesce(a_starts, a_ends, b_starts, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A and each B token: a group ends where all tokens before have ended."""
    starts, ends = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
    kind = np.repeat([0, 1], [len(a_starts), len(b_starts)])
    order = np.lexsort((kind, starts))
    reached = np.maximum.accumulate(ends[order]) if len(order) else ends
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(starts[order][1:] >= reached[:-1])])[: len(order)]
    return group[: len(a_starts)], group[len(a_starts) :]


def overlaps(a_starts, a_ends, b_starts, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all A and B tokens that share a byte, by A, then B."""
    low = np.searchsorted(b_ends, a_starts, "right")
    many = np.searchsorted(b_starts, a_ends, "left") - low
    a = np.repeat(np.arange(len(a_starts)), many)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + low[a]


class Aligner:
    """Aligns units with two vocabularies: A byte-level, B of pieces."""

    def __init__(self, a_vocabulary: str, b_model: bytes):
        self.a, self.b = ByteEncoder(a_vocabulary), PieceEncoder(b_model)
        self.b_octets = pa.array([self._octets(i) for i in range(self.b.size)], pa.large_binary())
        self.b_lengths = np.array([len(o) for o in self.b_octets.to_pylist()])
        self.b_at = len(self.a.lengths)
        names = [f"{i}".encode() for i in range(self.b_at)] + [f"{i}".encode() for i in range(self.b.size)]
        ends = [b"|"] * self.b_at + [b";"] * self.b.size
        # first with a comma, then with the sign that ends the side of a group
        self.names = pa.array([n + b"," for n in names] + [n + e for n, e in zip(names, ends)], pa.large_binary())

    def _octets(self, i: int) -> bytes:
        piece = self.b.library.id_to_piece(i)
        if self.b.library.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(U.SPACE_SIGN, " ").encode()

    @staticmethod
    def _same(distinct: pa.Array, octets: pa.Array, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Units whose joined token bytes are the unit."""
        data, marks = U.text_bytes_of(distinct)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        good = totals(sizes[ids], upto) == np.diff(marks)
        own, _ = U.text_bytes_of(octets.take(pa.array(ids[np.repeat(good, lengths)])))
        kept, ends = U.text_bytes_of(distinct.filter(pa.array(good)))
        wrong = np.concatenate([[0], np.cumsum(own != kept)])
        good[np.flatnonzero(good)[wrong[ends[1:]] != wrong[ends[:-1]]]] = False
        return good

    def align(self, distinct: pa.Array) -> dict:
        """Per unit: whether both vocabularies give its bytes back, numbers of tokens, groups and links.

        ``links``: (A id << 32 | B id) of every link, ``link_counts`` many per unit; ``spelled``:
        the groups as ``a1,a2|b1;a3|b2;``, nothing for a unit that is not ``good``.
        """
        found = [self._align(distinct.slice(low, UNITS)) for low in range(0, max(len(distinct), 1), UNITS)]
        out = {name: np.concatenate([f[name] for f in found]) for name in found[0] if name != "spelled"}
        return out | {"spelled": pa.concat_arrays([f["spelled"] for f in found])}

    def _align(self, distinct: pa.Array) -> dict:
        a, n_a = self.a.encode_units(distinct)
        b, n_b = self.b.encode_units(distinct)
        b = b.astype(np.int64)
        good = self._same(distinct, self.a.octets, self.a.lengths, a, n_a)
        good &= self._same(distinct, self.b_octets, self.b_lengths, b, n_b)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b_lengths[b])
        a_starts, b_starts = a_ends - self.a.lengths[a], b_ends - self.b_lengths[b]
        a_group, b_group = coalesce(a_starts, a_ends, b_starts, b_ends)
        left, right = overlaps(a_starts, a_ends, b_starts, b_ends)
        unit_a = np.repeat(np.arange(len(good)), n_a)
        ends = np.concatenate([a_group[1:] != a_group[:-1], [True]]) if len(a) else np.empty(0, bool)
        b_last = np.concatenate([b_group[1:] != b_group[:-1], [True]]) if len(b) else np.empty(0, bool)
        # A tokens of a group, then its B tokens: a stable sort by (group, side)
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(np.concatenate([a_group, b_group]) * 2 + side, kind="stable")
        names = np.concatenate([a, b + self.b_at]) + np.concatenate([ends, b_last]) * (self.b_at + self.b.size)
        spelled = U.split_values(self.names.take(pa.array(names[order])), n_a + n_b)
        groups = np.bincount(unit_a[ends], minlength=len(good)) if len(a) else np.zeros(len(good), np.int64)
        return {
            "good": good, "n_a": n_a, "n_b": n_b, "n_groups": groups, "spelled": spelled,
            "links": a[left] << 32 | b[right], "link_counts": np.bincount(unit_a[left], minlength=len(good)),
        }


# --- Spark jobs -------------------------------------------------------------------------------

_INTS = ["n_a", "n_b", "n_groups", "n_links"]
_CHUNK = (
    "chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, sizes array<int>, doc_first binary, doc_units binary, unit_first binary, unit_links binary, "
    "code array<bigint>, docs array<bigint>"
)
_RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)


def _vocabularies(docs: DataFrame, a_path: str, b_path: str):
    """Both files, of fixed size, for all tasks."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def _list(values) -> pa.Array:
    """One list value."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")


def _good_texts(units: U.Units, good: np.ndarray) -> np.ndarray:
    bad = totals((~good[units.numbers]).astype(np.int64), units.first)
    return (bad == 0) & (units.counts > 0)


def _chunk_row(aligner: Aligner, part: pa.Table, chunk: int) -> pa.RecordBatch:
    units = U.Units(part.column("text"))
    found = aligner.align(units.distinct)
    whole = _good_texts(units, found["good"])
    stats = {
        "n_a": found["n_a"], "n_b": found["n_b"], "n_groups": found["n_groups"], "n_links": found["link_counts"],
    }
    sums = {c: totals(v[units.numbers], units.first) * whole for c, v in stats.items()}
    data, bounds = U.cut(found["spelled"], units)
    digests = [d if w else "" for d, w in zip(U.joined_sha256(data, bounds), whole)]
    counts = units.counts * whole
    doc_units = units.numbers[np.repeat(whole, units.counts)].astype(np.int64)
    # links by number; each document counts a pair once
    number, codes = _numbers(found["links"])
    first = np.concatenate([[0], np.cumsum(found["link_counts"])])
    owner = np.repeat(np.arange(len(counts)), counts)
    held = np.asarray(pc.unique(pa.array(owner * len(units.distinct) + doc_units)))
    of, unit = held // max(len(units.distinct), 1), held % max(len(units.distinct), 1)
    many = found["link_counts"][unit]
    docs = np.zeros(len(codes), np.int64)
    for low, high in _slices(of, many):
        n = many[low:high]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[unit[low:high]], n)
        pairs = np.asarray(pc.unique(pa.array(np.repeat(of[low:high], n) * len(codes) + number[at])))
        docs += np.bincount(pairs % max(len(codes), 1), minlength=len(codes))
    # what only the last pass reads travels packed
    packed = [np.concatenate([[0], np.cumsum(counts)]), doc_units, first, number]
    lists = [
        part.column("doc_id").combine_chunks(), *(sums[c] for c in _INTS), pa.array(digests, pa.string()),
        np.array([len(p) for p in packed], np.int32),
    ]
    blobs = [pa.array([squeeze(p.astype(np.int32))], pa.binary()) for p in packed]
    names = [c.split()[0] for c in _CHUNK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([chunk]), *map(_list, lists), *blobs, _list(codes), _list(docs)], names)


def _slices(of: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of whole documents with about ``SLICE_LINKS`` links together."""
    ends = np.flatnonzero(np.concatenate([of[1:] != of[:-1], [True]])) + 1 if len(of) else np.empty(0, np.int64)
    sums = np.cumsum(many)
    low = 0
    while low < len(of):
        done = sums[low - 1] if low else 0
        i = max(int(np.searchsorted(sums[ends - 1], done + SLICE_LINKS, "right")) - 1, int(np.searchsorted(ends, low, "right")))
        yield low, int(ends[i])
        low = int(ends[i])


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    coded = pa.array(values).dictionary_encode()
    return np.asarray(coded.indices), np.asarray(coded.dictionary)


def aligned_chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """First pass, written: one row per chunk of the corpus, with its documents and distinct links."""
    both = _vocabularies(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk = Aligner(*both.value), TaskContext.get().partitionId() << 32
        for part in grouped(batches, "text", CHUNK_BYTES):
            yield _chunk_row(aligner, part, chunk)
            chunk += 1

    return written(_rows(docs).mapInArrow(run, _CHUNK), "cross-align-chunks")


def link_counts(chunks: DataFrame) -> DataFrame:
    """``code, n, best``: documents that hold each pair of ids linked, and whether no pair of its A
    id has more.  Chunks have counted already, so a common pair has one row a chunk."""
    cells = chunks.select(F.inline(F.arrays_zip("code", "docs"))).where("docs > 0")  # units of odd texts alone have 0
    counted = cells.groupBy("code").agg(F.sum("docs").alias("n"))
    counted = written(counted.withColumn("a_id", F.shiftright("code", 32)), "cross-align-counts")
    most = counted.groupBy("a_id").agg(F.max("n").alias("most"))
    return counted.join(most, "a_id").select("a_id", "code", "n", (F.col("n") == F.col("most")).alias("best"))


def link_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a_id, b_id, n_docs, best`` of every pair of ids that some document links."""
    found = link_counts(aligned_chunks(docs, a_path, b_path))
    return found.select("a_id", F.expr("code & 4294967295").alias("b_id"), F.col("n").alias("n_docs"), "best")


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document the tokens of both vocabularies, groups, links and how usual its links are.

    Null and empty texts, and texts that a vocabulary does not give back byte for byte, have no
    tokens: zeros and an empty digest.  Repeated rows are documents of their own, in the counts
    too; null ids keep their row; equal counts are all best; further columns are ignored; an
    empty table gives no rows.
    """
    chunks = aligned_chunks(docs, a_path, b_path)
    cells = chunks.select("chunk", F.posexplode("code").alias("pos", "code"))
    counts = cells.join(link_counts(chunks), "code").select(
        F.col("chunk").alias("of_chunk"), "pos", "n", "best"
    )

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = {c: left.column(c).combine_chunks().flatten() for c in ("doc_id", *_INTS, "groups_sha256", "sizes")}
        packed = ("doc_first", "doc_units", "unit_first", "unit_links")
        doc_first, doc_units, unit_first, links = (
            expand(left.column(c)[0].as_py(), n, np.int32) for c, n in zip(packed, flat["sizes"].to_pylist())
        )
        count, best = np.zeros((2, int(links.max(initial=-1)) + 1), np.int64)
        place = right.column("pos").to_numpy()
        count[place], best[place] = right.column("n").to_numpy(), np.asarray(right.column("best").cast(pa.int64()))

        def per_text(values: np.ndarray) -> pa.Array:
            return pa.array(totals(totals(values[links], unit_first)[doc_units], doc_first))

        names = [c.split()[0] for c in _RESULT.split(", ")]
        flat |= {"n_best": per_text(best), "count_sum": per_text(count)}
        return pa.Table.from_arrays([flat[c].cast(pa.string()) if c == "groups_sha256" else flat[c] for c in names], names)

    sides = chunks.drop("code", "docs").groupBy("chunk").cogroup(counts.groupBy("of_chunk"))
    return sides.applyInArrow(sums, _RESULT)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, a_ids, b_ids``: per document the groups in order, each the ids of its A and of its
    B tokens.  Odd texts have no groups, as in :func:`align_documents`."""
    both = _vocabularies(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*both.value)
        for part in grouped(batches, "text", CHUNK_BYTES):
            units = U.Units(part.column("text"))
            found = aligner.align(units.distinct)
            whole = _good_texts(units, found["good"])
            data, bounds = U.cut(found["spelled"], units)
            rows = []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                text = bytes(data[a:b]).decode() if whole[i] else ""
                sides = [g.split("|") for g in text.split(";")[:-1]]
                rows.append([[[int(x) for x in s[k].split(",")] for s in sides] for k in (0, 1)])
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks(), *(pa.array([r[k] for r in rows], lists) for k in (0, 1))],
                ["doc_id", "a_ids", "b_ids"],
            )

    return _rows(docs).mapInArrow(run, "doc_id bigint, a_ids array<array<int>>, b_ids array<array<int>>")
