"""Piece encoding of merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs.

A text starts as its characters.  While some two neighbours form a piece of the vocabulary, the
pair of the best score is merged, the leftmost of equals first.  Texts are cut into units that
no piece spans (``units``), each distinct unit of a batch is merged once, and units of equal
length share one agenda: a matrix of pair ranks whose row minimum is the next merge of its unit.
Units beyond ``LONG`` characters have a heap each, after a cut between characters that no piece
has side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opslens.llm import units as U
from opslens.llm.agenda import _NEVER, LONG, PairTable
from opslens.llm.words import binary_array, pieces

#: Text bytes encoded at once.
BATCH_BYTES = 8 << 20


class PieceEncoder:
    """Encodes as the vocabulary's own library does, without begin or end ids.

    Vocabularies must be of the merge type, leave texts as they are but for spaces, put a space
    before a text, and fall back to bytes; others are refused.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = SentencePieceProcessor(model_proto=model)
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        rules, normal, kind = spec.normalizer_spec, 1, spec.trainer_spec.model_type
        if kind != 2 or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type vocabulary with byte fallback")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("the vocabulary changes texts before it encodes them")
        if any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(spec.pieces)
        number = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == normal}
        self.byte = np.zeros(256, np.int32)
        for i, p in enumerate(spec.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
        # characters that occur in pieces but are none get symbols beyond the vocabulary
        letters = sorted({c for piece in number for c in piece})
        symbol = dict(number)
        for c in letters:
            symbol.setdefault(c, self.size + len(symbol))
        self.symbol_of = -np.arange(0x110000, dtype=np.int32) - 1  # a foreign character
        for c in letters:
            self.symbol_of[ord(c)] = symbol[c]
        self.symbol_of[32] = self.symbol_of[ord(U.SPACE_SIGN)]
        if any(c != U.SPACE_SIGN and piece.find(c + U.SPACE_SIGN) >= 0 for piece in number for c in set(piece)):
            raise ValueError("a piece spans the end of a word")
        ranks = {s: r for r, s in enumerate(sorted({p.score for p in spec.pieces if p.type == normal}, reverse=True))}
        rows = [
            (symbol[piece[:k]], symbol[piece[k:]], i, ranks[spec.pieces[i].score])
            for piece, i in number.items()
            for k in range(1, len(piece))
            if piece[:k] in symbol and piece[k:] in symbol
        ]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*rows)))
        beside = {(symbol[a], symbol[b]) for piece in number for a, b in zip(piece, piece[1:])}
        self.beside = PairTable(*(np.array(x, np.int64) for x in zip(*((a, b, 0, 0) for a, b in sorted(beside)))))
        # a lone character symbol that is no piece is written in bytes, as foreign characters are
        self.char_of = {s: ord(c) for c, s in symbol.items() if s >= self.size}

    def encode_units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, one unit after the other, and how many each has."""
        data, _ = U.text_bytes_of(distinct)
        sizes = _characters(distinct)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(distinct), np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[points]
        alive = self.pairs.merge(symbols, self._cut_long(symbols, sizes))
        kept = symbols[alive]
        owner = np.repeat(np.arange(len(sizes)), sizes)[alive]
        odd = np.flatnonzero((kept < 0) | (kept >= self.size))
        if not len(odd):
            return kept, np.bincount(owner, minlength=len(sizes))
        octets = [
            self.byte[np.frombuffer(chr(-s - 1 if s < 0 else self.char_of[s]).encode(), np.uint8)] for s in kept[odd].tolist()
        ]
        lengths = np.ones(len(kept), np.int64)
        lengths[odd] = [len(o) for o in octets]
        out, owner = np.repeat(kept, lengths), np.repeat(owner, lengths)
        spread = np.zeros(len(kept), bool)
        spread[odd] = True
        out[np.repeat(spread, lengths)] = np.concatenate(octets)
        return out, np.bincount(owner, minlength=len(sizes))

    def _cut_long(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sizes after long units are cut between characters that no piece has side by side."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.zeros(len(symbols) + 1, bool)
        edge[starts] = True
        for row in np.flatnonzero(sizes > LONG).tolist():
            low, high = int(starts[row]), int(starts[row + 1])
            _, known = self.beside.find(symbols[low : high - 1], symbols[low + 1 : high])
            edge[low + 1 : high][known == _NEVER] = True
        return np.diff(np.flatnonzero(edge))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and how many each text has; null and empty texts have none."""
        units = U.Units(column)
        ids, lengths = self.encode_units(units.distinct)
        values = binary_array(np.concatenate([[0], np.cumsum(lengths)]) * 4, ids.astype(np.int32).view(np.uint8))
        data, bounds = U.cut(values, units)
        return np.frombuffer(data, np.int32), np.diff(bounds) // 4

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The library's texts of the ids."""
        ends = np.cumsum(lengths)
        lists = [part.tolist() for part in np.split(ids, ends[:-1])] if len(lengths) else []
        return self.library.decode(lists, num_threads=1) if lists else []


def _characters(values: pa.Array) -> np.ndarray:
    """Characters of each UTF-8 value."""
    data, marks = U.text_bytes_of(values)
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return upto[marks[1:]] - upto[marks[:-1]]


# --- Spark jobs -------------------------------------------------------------------------------

_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _model(docs: DataFrame, path: str):
    """The model file, which has a fixed size, for all tasks."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` of every document; a null or empty text has no ids, repeated rows are
    encoded as often as they occur, further columns are ignored, an empty table gives no rows."""
    model = _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model.value)
        for batch in pieces(batches, "text", BATCH_BYTES):
            ids, lengths = encoder.encode(batch.column("text"))
            marks = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(marks), pa.array(ids))], ["doc_id", "ids"]
            )

    return _rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null or no ids give an empty text."""
    model = _model(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model.value)
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            texts = encoder.library.decode(ids, num_threads=1) if ids else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(ids AS array<int>) AS ids").mapInArrow(
        run, "doc_id bigint, text string"
    )


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids in decimal and of the decoded text.

    A null text counts as empty: no ids, both digests of nothing.  Repeated rows and null ids
    have rows of their own; further columns are ignored; an empty table gives no rows.
    """
    import hashlib

    model = _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model.value)
        names = pa.array([f"{i},".encode() for i in range(encoder.size)], pa.large_binary())
        for batch in pieces(batches, "text", BATCH_BYTES):
            units = U.Units(batch.column("text"))
            ids, lengths = encoder.encode_units(units.distinct)
            data, bounds = U.cut(U.split_values(names.take(pa.array(ids)), lengths), units)
            octets = binary_array(np.concatenate([[0], np.cumsum(lengths)]) * 4, ids.astype(np.int32).view(np.uint8))
            flat, marks = U.cut(octets, units)
            texts = encoder.decode(np.frombuffer(flat, np.int32), np.diff(marks) // 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(marks) // 4),
                    pa.array(U.joined_sha256(data, bounds)),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _rows(docs).mapInArrow(run, _DIGESTS)


def differences(docs: DataFrame, model_path: str) -> DataFrame:
    """Documents whose ids or decoded text differ from what the library gives for the whole text,
    batch by batch: ``doc_id, ids, library_ids``.  No rows when both agree."""
    model = _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model.value)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("library_ids", pa.list_(pa.int32()))])
        for batch in pieces(batches, "text", BATCH_BYTES):
            ids, lengths = encoder.encode(batch.column("text"))
            mine = [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])]
            theirs = encoder.library.encode([t or "" for t in batch.column("text").to_pylist()], num_threads=1)
            rows = [
                {"doc_id": d, "ids": a, "library_ids": b}
                for d, a, b in zip(batch.column("doc_id").to_pylist(), mine, theirs)
                if a != b
            ]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>, library_ids array<int>")
