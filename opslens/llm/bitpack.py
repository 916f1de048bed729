"""Token ids in the fewest bits: ``.bits`` files with block offsets.

A file holds whole documents in order::

    magic "TBITS01\\0" | width u32 | block ids u32 | documents u64 | ids u64 | table place u64
    blocks: each ``block`` ids, ``width`` bits an id, least significant bit first, padded to a byte
    table:  place of each block (u64), ids before each document and in all (u64),
            doc_id of each document (i64), 1 where it is null (u8)

A reader seeks to the blocks that hold the ids it wants, so any document or range of ids
is read without the rest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.llm.agenda import PairTable
from opslens.llm.shared import parts, written
from opslens.llm.units import byte_symbols, text_bytes_of
from opslens.llm.words import LOWER, SPACE, binary_array, numbered, pieces, text_bytes
from opslens.session import fresh_dir

MAGIC = b"TBITS01\0"
HEADER = "<8sIIQQQ"
BLOCK_IDS = 1 << 14
END_ID = 1
#: Words encoded by the tokenizer whose ids a task remembers.
REMEMBERED = 1 << 19


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each id, least significant first."""
    if width in (8, 16, 32):  # whole bytes need no shifting
        return np.ascontiguousarray(ids).astype(f"<u{width // 8}").tobytes()
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    bits = np.unpackbits(octets, axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    full = np.zeros((count, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


class BitWriter:
    """Writes documents one after another; memory holds one block and the table."""

    def __init__(self, out, width: int, block: int = BLOCK_IDS):
        self.out, self.width, self.block = out, width, block
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.places, self.ends, self.doc_ids, self.nulls = [struct.calcsize(HEADER)], [np.zeros(1, np.int64)], [], []
        out.write(b"\0" * struct.calcsize(HEADER))

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)
        self.ends.append(self.ids + np.cumsum(lengths))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(self.held // self.block * self.block)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        for start in range(0, count, self.block):
            data = pack(ids[start : min(start + self.block, count)], self.width)
            self.out.write(data)
            self.places.append(self.places[-1] + len(data))
        self.waiting, self.held = [ids[count:]], len(ids) - count

    def close(self) -> int:
        self._flush(self.held)
        place = self.places[-1]
        docs = np.concatenate(self.doc_ids) if self.doc_ids else np.empty(0, np.int64)
        nulls = np.concatenate(self.nulls) if self.nulls else np.empty(0, np.uint8)
        for array, kind in ((self.places[:-1], "<u8"), (np.concatenate(self.ends), "<u8"), (docs, "<i8"), (nulls, "u1")):
            self.out.write(np.asarray(array, kind).tobytes())
        self.out.write(struct.pack(HEADER, MAGIC, self.width, self.block, len(docs), self.ids, place))
        return len(docs)


class BitReader:
    """Random access to one file; the header stands at the end, behind the table."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - struct.calcsize(HEADER))
        magic, self.width, self.block, self.docs, self.ids, place = struct.unpack(HEADER, source.read(struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError("not a .bits file")
        blocks = -(-self.ids // self.block)
        source.seek(place)
        read = lambda n, kind: np.frombuffer(source.read(n * np.dtype(kind).itemsize), kind)
        self.places, self.marks = read(blocks, "<u8"), read(self.docs + 1, "<u8").astype(np.int64)
        self.doc_ids, self.nulls = read(self.docs, "<i8"), read(self.docs, "u1")

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive) of the file."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        out = []
        for b in range(first, last + 1):
            count = min(self.block, self.ids - b * self.block)
            self.source.seek(int(self.places[b]))
            out.append(unpack(self.source.read(-(-count * self.width // 8)), self.width, count))
        ids = np.concatenate(out)
        return ids[start - first * self.block : end - first * self.block]

    def document(self, index: int) -> np.ndarray:
        return self.range(int(self.marks[index]), int(self.marks[index + 1]))


# --- encoding ---------------------------------------------------------------------------------

# Byte classes of simple words: 1 letter, 2 digit, 3 mark, 0 anything else (an apostrophe, for one).
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[ord("'")] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1


class Encoder:
    """Encodes texts with the vocabulary, each distinct piece of a batch once.

    The vocabulary drops white space and never joins over it, so words can be encoded alone.
    Words of ASCII and Latin-1 letters, digits and marks are cut further, where the vocabulary's own
    pattern cuts: runs of letters, single digits, runs of marks.  These pieces are merged by the
    vocabulary's ranks, all at once (``agenda``).  Every other word goes through the tokenizer
    whole.  Tests hold the result against encoding whole texts.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        model = json.loads(vocabulary)["model"]
        number, self.end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for letter, octet in symbols.items():
            self.inner[octet], self.last[octet] = number[letter], number[letter + self.end]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rows = [(number[a], number[b], number[a + b], rank) for rank, (a, b) in enumerate(merges)]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*rows)))
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[bytes, np.ndarray] = {}

    def _merged(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple pieces, and how many each has."""
        data, marks = text_bytes_of(values)
        data = LOWER[data]
        # a capital Latin-1 letter: C3 and 80..9E but for the sign among them
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)]
        data[lead + 1] += 32
        table = self.inner[data]
        table[marks[1:] - 1] = self.last[data[marks[1:] - 1]]
        sizes = np.diff(marks)
        alive = self.pairs.merge(table, sizes)
        return table[alive].astype(np.uint32), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[alive], minlength=len(sizes))

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of other words, through the tokenizer, remembered by the task."""
        new = [t for t in texts if t not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, texts
        found = self.whole.encode_batch_fast([t.decode() for t in new], add_special_tokens=False) if new else []
        self.known.update((t, np.array(e.ids, np.uint32)) for t, e in zip(new, found))
        ids = [self.known[t] for t in texts]
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        kind = _CLASS[data]
        # two-byte Latin-1 letters: C3 80..BF without the two signs
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        for token in self.special:  # stands for itself wherever it occurs
            kind[[m.start() for m in re.finditer(re.escape(token), memoryview(data))]] = 0
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[offsets] = True
        edge[0] = edge[-1] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1][inside[cuts[:-1]]], cuts[1:][inside[cuts[:-1]]]
        odd = np.concatenate([[0], np.cumsum(inside & (kind == 0))])
        plain = odd[ends] == odd[starts]  # words that may be cut further
        spread = np.zeros(len(data) + 1, np.int8)
        spread[starts[plain]] = 1
        spread[ends[plain]] -= 1
        in_plain = np.cumsum(spread[:-1]).astype(bool)
        further = np.zeros(len(data) + 1, bool)
        further[1:-1] = in_plain[1:] & in_plain[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        edge |= further
        cuts = np.flatnonzero(edge)
        full = inside[cuts[:-1]]
        starts, ends = cuts[:-1][full], cuts[1:][full]
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        marks = np.concatenate([[0], np.cumsum(ends - starts)])
        # lower case merges pieces; only in words that are cut, as others may compose
        folded = np.where(in_plain, LOWER[data], data)[inside]
        numbers, distinct = numbered(binary_array(marks, folded))
        simple = np.zeros(len(distinct), bool)
        simple[numbers] = in_plain[starts]
        one, one_sizes = self._merged(distinct.filter(pa.array(simple)))
        two, two_sizes = self._whole(distinct.filter(pa.array(~simple)).to_pylist())
        sizes, place = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        sizes[simple], sizes[~simple] = one_sizes, two_sizes
        place[simple], place[~simple] = np.cumsum(one_sizes) - one_sizes, len(one) + np.cumsum(two_sizes) - two_sizes
        table = np.concatenate([one, two])
        lengths = sizes[numbers]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = table[np.repeat(place[numbers] - upto[:-1], lengths) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to every document."""
    return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32), lengths + 1


# --- Spark jobs -------------------------------------------------------------------------------

_MANIFEST = "path string, first_id bigint, first_null boolean, first_text bigint, documents bigint, ids bigint"


def _write(vocabulary, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, first = Encoder(vocabulary.value), None, None
        store, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/{uuid.uuid4().hex}.bits"
        for batch in pieces(batches, "text"):
            if writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(path)
                writer = BitWriter(out, width_of(encoder.whole.get_vocab_size()))
                first = {c: batch.column(c)[0].as_py() for c in ("doc_id", "text_hash")}
            ids, lengths = with_end(*encoder.encode(batch.column("text")), end_id)
            docs = batch.column("doc_id")
            writer.add(np.asarray(pc.fill_null(docs, 0)), np.asarray(docs.is_null()).astype(np.uint8), lengths, ids)
        if writer is not None:
            count = writer.close()
            out.close()
            row = {
                "path": path,
                "first_id": first["doc_id"],
                "first_null": first["doc_id"] is None,
                "first_text": first["text_hash"],
                "documents": count,
                "ids": writer.ids,
            }
            yield pa.RecordBatch.from_pylist([row], schema=_manifest_schema())

    return run


def _manifest_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _MANIFEST.split(", "))])


def write_bits(docs: DataFrame, vocabulary_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents in ascending ``doc_id`` order; returns the manifest.

    Ids are unpadded bits of the vocabulary's width in files below ``folder`` (a URI all
    executors reach; a fresh one in the shared folder by default).  Range partitions of
    (doc_id, text hash) make one file each, so a repeated id can spread over files.  A null
    id comes first; null and empty texts have the end id only.  Files of failed attempts are
    never in the manifest: one row per file with its path, first key, documents and ids, and the
    ids before it (``start``).
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # a file of fixed size
    folder = folder or fresh_dir(spark, "bits")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc()]
    ranged = rows.repartitionByRange(parts(docs), *order).sortWithinPartitions(*order)
    manifest = written(ranged.mapInArrow(_write(vocabulary, folder, end_id), _MANIFEST), "bits-manifest")
    # one row per file
    before = Window.orderBy(F.desc("first_null"), "first_id", "first_text").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read(folder: str, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as source:
                    reader = BitReader(source)
                    yield from _digests(reader, row["start"], step)

    return run


def _digests(reader: BitReader, start: int, step: int) -> Iterable[pa.RecordBatch]:
    low = 0
    while low < reader.docs:
        high = int(np.searchsorted(reader.marks, reader.marks[low] + step, "right")) - 1
        high = min(max(high, low + 1), reader.docs)
        marks = reader.marks[low : high + 1]
        ids = reader.range(int(marks[0]), int(marks[-1]))
        octets = memoryview(ids.astype("<u4").tobytes())
        at = (marks - marks[0]) * 4
        sums = [zlib.crc32(octets[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(reader.doc_ids[low:high], pa.int64(), mask=reader.nulls[low:high].astype(bool)),
                pa.array(marks[:-1] + start),
                pa.array(np.diff(marks)),
                pa.array(sums, pa.int64()),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )
        low = high


def read_digests(manifest: DataFrame, folder_uri: str, step: int = 1 << 20) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return manifest.select("path", "start").repartition(parts(manifest)).mapInArrow(_read(folder_uri, step), schema)


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents as packed ids, read the files back and digest each document.

    Repeated rows are written as often as they occur; an empty table writes no file and gives no
    rows; further columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    folder = fresh_dir(spark, "bits")
    return read_digests(write_bits(docs, vocabulary_path, folder, end_id), folder)
