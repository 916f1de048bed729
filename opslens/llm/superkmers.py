"""Substring deduplication by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  Its minimiser is the least hash of its
grams of ``window // 4`` words; consecutive windows with the same minimiser form a super-k-mer,
which is packed as one string and sent to its minimiser's bucket.  Equal windows have equal
minimisers and meet in one bucket, where sorting by exact names counts them and finds the
first document of each.

What keeps it small: a super-k-mer travels only if documents share its minimiser (a bitmap of fixed
size; a chance hit sends one more, never one less); a task merges equal strings before it sends
them; a minimiser with more than ``HOT`` super-k-mers is dealt out by single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.shared import bitmap, in_bitmap, parts, spot_of, written
from opslens.llm.words import Words, hashes, mix64, numbered, pair_ids, pieces

WINDOW = 50
HOT = 20_000
SHARED_BITS = 26
HOT_BITS = 22
#: Text bytes cut at once where strings are packed; up to three times as many come out.
CUT_BYTES = 2 << 20
#: Bytes of distinct strings that a cutting task holds before it passes them on.
HELD_BYTES = 24 << 20
#: Packed bytes that a bucket task sorts at once, unless one minimiser has more.
BUCKET_BYTES = 4 << 20
LAST = (1 << 63) - 1  # stands for a null id, which comes after all others
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """``values`` moved forward; places past the end repeat the last value."""
    return np.concatenate([values[by:], np.repeat(values[-1:], min(by, len(values)))])


def _doubled(values: np.ndarray, length: int, join) -> np.ndarray:
    """Join ``length`` neighbours from each place on; overlapping halves make up odd lengths."""
    have, out = 1, values
    while 2 * have <= length:
        out, have = join(out, _ahead(out, have)), 2 * have
    return join(out, _ahead(out, length - have)) if have < length else out


def _hash_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * _BASE + b)


class Cut:
    """Super-k-mers of a text column: first window (a word's index), windows, minimiser, text."""

    def __init__(self, column: pa.Array, window: int):
        words = self.words = Words(column)
        ids, distinct = words.ids()
        self.window = window
        count = len(ids)
        inside = np.zeros(count, bool)
        owner = words.owner
        if count >= window:
            inside[: count - window + 1] = owner[window - 1 :] == owner[: count - window + 1]
        if not inside.any():
            self.start = self.count = self.minimiser = self.text = np.empty(0, np.int64)
            return
        gram = max(1, window // 4)
        value = _doubled(hashes(distinct)[ids], gram, _hash_pair)
        least = _doubled(value, window - gram + 1, np.minimum).view(np.int64)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        self.start = np.flatnonzero(begins)
        self.count = np.diff(np.append(np.cumsum(inside)[self.start] - 1, inside.sum()))
        self.minimiser, self.text = least[self.start], owner[self.start]

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and the place of each word in it."""
        words = self.words
        size = np.diff(words.marks)
        places = words.marks + np.arange(len(words.marks))
        out = np.full(int(places[-1]), 32, np.uint8)
        body = np.frombuffer(words.values.buffers()[2], np.uint8)[: words.marks[-1]]
        out[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = body
        return out.tobytes(), places


def _first_places(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            cut = Cut(batch.column("text"), window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cut.minimiser), batch.column("doc_id").take(pa.array(cut.text))], ["minimiser", "doc_id"]
            )

    return run


_PIECES = "key bigint, sid binary, packed binary, low bigint, high bigint, doc_id bigint, text_key bigint, start int"


def _pieces(window: int, sent):
    """Two kinds of rows: every place of a string (``sid, doc_id, text_key, start``), and each distinct
    string with its bucket and its least and greatest id, once per ``HELD_BYTES`` of strings."""
    names = [c.split()[0] for c in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def strings(held: dict) -> pa.RecordBatch:
        columns = list(zip(*((key, sid, packed, low, high) for sid, (key, packed, low, high) in held.items())))
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(held), k) for k in kinds[5:]]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = sent.value
        held: dict[bytes, tuple[int, bytes, int, int]] = {}
        size = 0
        for batch in pieces(batches, "text", CUT_BYTES):
            cut = Cut(batch.column("text"), window)
            wanted = np.flatnonzero(in_bitmap(shared, _spot(cut.minimiser, SHARED_BITS)))
            if not len(wanted):
                continue
            start, count, minimiser, text = (c[wanted] for c in (cut.start, cut.count, cut.minimiser, cut.text))
            single = in_bitmap(hot, _spot(minimiser, HOT_BITS))
            times = np.where(single, count, 1)
            first = np.repeat(start, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            many = np.repeat(np.where(single, 1, count), times)
            key, alone, text = np.repeat(minimiser, times), np.repeat(single, times), np.repeat(text, times)
            doc_id = batch.column("doc_id").take(pa.array(text))
            data, places = cut.joined()
            sids = []
            ends = places[first + many + window - 1] - 1
            for a, b, k, one, doc in zip(places[first].tolist(), ends.tolist(), key.tolist(), alone.tolist(), doc_id.to_pylist()):
                packed = data[a:b]
                sid = hashlib.blake2b(packed, digest_size=16).digest()
                sids.append(sid)
                if sid in held:
                    k, packed, low, high = held[sid]
                    held[sid] = (k, packed, min(low, doc), max(high, doc))
                else:
                    # a window of a hot minimiser has a bucket of its own
                    k = int.from_bytes(sid[:8], "little", signed=True) if one else k
                    held[sid] = (k, packed, doc, doc)
                    size += len(packed) + 200
            nothing = [pa.nulls(len(sids), k) for k in kinds]
            place = pa.array(first - cut.words.first[text], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [nothing[0], pa.array(sids, pa.binary()), *nothing[2:5], doc_id, batch.column("text_key").take(pa.array(text)), place],
                names,
            )
            if size > HELD_BYTES:
                yield strings(held)
                held, size = {}, 0
        if held:
            yield strings(held)

    return run


def _spot(minimiser: np.ndarray, bits: int) -> np.ndarray:
    """A minimiser is a mixed hash already: its high bits are its spot."""
    return (minimiser.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


_FIRSTS = "sid binary, found array<struct<skip:int,many:int,first:bigint>>"


def _bucket(window: int):
    """The first document of every window; strings whose windows are nowhere repeated are left out."""

    def sort(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        number = numbered(table.column("sid").combine_chunks())[0]
        low, high = np.full(number.max() + 1, LAST), np.full(number.max() + 1, -LAST - 1)
        np.minimum.at(low, number, table.column("low").to_numpy())
        np.maximum.at(high, number, table.column("high").to_numpy())
        place = np.zeros(len(low), np.int64)
        place[number] = np.arange(len(number))
        table = table.select(["sid", "packed"]).take(pa.array(place))  # each string once
        words = Words(table.column("packed"))
        names = _doubled(words.ids()[0].astype(np.int64), window, pair_ids)
        count = words.counts - window + 1
        string = np.repeat(np.arange(len(count)), count)
        skip = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
        name = names[words.first[:-1][string] + skip]
        order = np.argsort(name, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
        first = np.empty(len(name), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(low[string][order], edge), np.diff(np.append(edge, len(name))))
        # runs of windows with the same first document, where some document is later than it
        change = np.concatenate([[True], (first[1:] != first[:-1]) | (string[1:] != string[:-1])])
        begin = np.flatnonzero(change)
        many = np.diff(np.append(begin, len(first)))
        later = first[begin] < high[string[begin]]
        begin, many = begin[later], many[later]
        of = string[begin]
        run = pa.StructArray.from_arrays(
            [pa.array(skip[begin], pa.int32()), pa.array(many, pa.int32()), pa.array(first[begin])], ["skip", "many", "first"]
        )
        kept, sizes = np.unique(of, return_counts=True)
        marks = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        sids = table.column("sid").combine_chunks().take(pa.array(kept))
        return pa.RecordBatch.from_arrays([sids, pa.ListArray.from_arrays(marks, run)], ["sid", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in pieces(batches, "packed"):
            keys = batch.column("key").to_numpy()
            if size >= BUCKET_BYTES:
                cut = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)
                held.append(batch.slice(0, cut))
                if cut == len(keys):
                    continue
                yield sort(held)
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.column("packed").nbytes
            last = keys[-1]
        if held:
            yield sort(held)

    return run


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            words = Words(batch.column("__text"))
            values = words.values.to_pylist()
            gone, sums, texts = [], [], []  # per text
            for a, b, spans in zip(words.first[:-1], words.first[1:], batch.column("__spans").to_pylist()):
                keep = np.ones(b - a, bool)
                for span in spans or ():
                    keep[span["low"] : span["high"]] = False
                left = b" ".join(values[a + i] for i in np.flatnonzero(keep)) if spans else b" ".join(values[a:b])
                gone.append(int(b - a - keep.sum()))
                sums.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode())
            names = [n for n in batch.schema.names if n not in ("__text", "__spans")]
            out = [batch.column(n) for n in names]
            out += [pa.array(words.counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            extra = ["n_words", "n_removed", "kept_sha256"]
            if with_text:
                out, extra = [*out, pa.array(texts, pa.string())], [*extra, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, [*names, *extra])

    return run


def _spans(docs: DataFrame, window: int, hot: int) -> DataFrame:
    """``id, key, spans``: word ranges to remove, per id and text that has any."""
    context = docs.sparkSession.sparkContext
    first = docs.select("doc_id", "text").mapInArrow(_first_places(window), "minimiser bigint, doc_id bigint")
    met = first.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    met = written(met.where("low < high").select("minimiser", "n"), "substring-shared")
    sent = context.broadcast(
        (_marked(met, SHARED_BITS), _marked(met.where(F.col("n") > hot), HOT_BITS))
    )
    sent_pieces = written(docs.select("doc_id", "text_key", "text").mapInArrow(_pieces(window, sent), _PIECES), "substring-pieces", "zstd")
    strings = sent_pieces.where("packed IS NOT NULL").select("key", "sid", "packed", "low", "high")
    dealt = strings.repartition(parts(docs), "key").sortWithinPartitions("key")
    firsts = dealt.mapInArrow(_bucket(window), _FIRSTS)
    places = sent_pieces.where("packed IS NULL").select("sid", "doc_id", "text_key", "start").join(firsts, "sid")
    places = places.select("doc_id", "text_key", "start", F.inline("found")).where(F.col("first") < F.col("doc_id"))
    span = F.struct(
        (F.col("start") + F.col("skip")).alias("low"), (F.col("start") + F.col("skip") + F.col("many") + window - 1).alias("high")
    )
    return places.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.collect_set(span).alias("spans"))


def _marked(met: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of minimisers by their high bits."""
    spot = F.shiftrightunsigned("minimiser", 64 - bits)
    return bitmap(met.select(spot.alias("spot")), "spot", bits, hashed=False)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document (and ``kept_text``).

    A word goes if a window that covers it also starts in a document with a smaller id; windows are
    judged on the input.  Rows with one id never remove each other's words.  A null id comes after all
    others.  Null and empty texts, and those under a window, keep their words; repeated rows are
    treated alike; an empty table gives no rows.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    text = F.col("text").cast("string")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
        text.alias("text"),
    )
    spans = written(_spans(rows, window, hot), "substring-spans")
    found = rows.sparkSession.sparkContext.broadcast(bitmap(spans.select(F.xxhash64("id", "key").alias("row")), "row", SHARED_BITS))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text_key")).withColumn("spot", spot_of("row", SHARED_BITS)).drop("row")
    # only texts that lose words are shuffled, and those that fall on the same bit by chance
    touched = rows.mapInArrow(_taken(found, True), rows.schema).join(spans, F.expr("doc_id = id AND text_key = key"), "left")
    whole = rows.mapInArrow(_taken(found, False), rows.schema)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    parts_ = []
    for part, removed in ((touched, F.col("spans")), (whole, F.lit(None).cast(spans.schema["spans"].dataType))):
        named = part.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), removed.alias("__spans"), F.col("text").alias("__text"))
        parts_.append(named.mapInArrow(_kept(window, with_text), schema))
    return parts_[0].unionByName(parts_[1])


def _taken(sent, inside: bool):
    """The rows whose spot is (not) in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = in_bitmap(sent.value, batch.column("spot").to_numpy()) == inside
            yield batch.filter(pa.array(taken))

    return run
