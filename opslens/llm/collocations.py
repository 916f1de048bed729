"""Collocations by set-oriented mining over sorted occurrence relations.

The relation of length 1 holds every word occurrence, sorted by piece of text and position.  It
is persisted in chunks: a chunk has the sequence of its local phrase numbers, with breaks between
pieces, and its distinct phrases with their counts, dealt to buckets by hash.  A length is mined in
three steps: buckets sort and count their phrases over all chunks, the frequent ones go back
to the chunks that hold them (a semi-join), and neighbours in a chunk's sequence are merge-joined to the
relation of the next length.  A phrase meets its like once per chunk, never once per
occurrence, and travels packed with the others of its chunk and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.shared import parts, written
from opslens.llm.units import text_bytes_of
from opslens.llm.words import LOWER, _runs, binary_array, hashes, mix64, numbered, pair_ids, pieces, text_bytes

#: Text bytes of a chunk; a longer text makes a chunk of its own.
CHUNK_BYTES = 8 << 20
MIN_COUNT, MAX_WORDS, SHARE, TOP = 10, 3, 50, 2000
NO_LANG = "und"
_GAP = np.zeros(256, bool)
_GAP[[9, 32]] = True
_END = np.zeros(256, bool)
_END[[10, 11, 12, 13, *b".,;:!?"]] = True

#: Buckets of phrases for each shuffle partition of the session.
BUCKETS = 4

# A chunk's sequence (seq), its phrases of one bucket (base: number of the first one), or its words per language.
_RELATION = (
    "chunk bigint, bucket int, base int, size int, keys binary, lengths binary, counts binary, seq binary, length int, "
    "lang string, n bigint"
)
# A chunk's frequent phrases of one bucket, or a frequent phrase.
_FOUND = "chunk bigint, size int, place binary, ids binary, id bigint, f bigint, lang string, word string, left bigint, right bigint"


def zipped(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def unzipped(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers or rows of numbers, packed by byte planes."""
    octets = np.ascontiguousarray(values).view(np.uint8).reshape(max(len(values), 1), -1)
    return zipped(octets.T.tobytes())


def expand(data: bytes, count: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(unzipped(data, count * kind.itemsize), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, count).T).reshape(-1).view(kind)


def _batch(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.Table.from_arrays(
        [pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], schema=pa.schema([(n, kinds[k]) for n, k in fields])
    )


def _occurrences(column: pa.Array, langs: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Sequence of local word numbers with -1 between pieces; the words and their languages."""
    data, offsets = text_bytes(column)
    end = _END[data]
    starts, ends = _runs(~(_GAP[data] | end), offsets)
    if not len(starts):
        return np.empty(0, np.int32), pa.array([], pa.large_binary()), np.empty(0, np.int64)
    owner = np.searchsorted(offsets, starts, "right") - 1
    marks = np.concatenate([[0], np.cumsum(ends - starts)])
    spread = np.zeros(len(data) + 1, np.int8)
    spread[starts] = 1
    spread[ends] -= 1
    word, distinct = numbered(binary_array(marks, LOWER[data[np.cumsum(spread[:-1]).astype(bool)]]))
    spoken = np.asarray(langs)[owner]
    both = pair_ids(spoken, word)
    first = np.empty(int(both.max()) + 1, np.int64)
    first[both[::-1]] = np.arange(len(both))[::-1]
    ended = np.cumsum(end)[starts]
    breaks = np.flatnonzero((np.diff(ended) > 0) | (np.diff(owner) > 0)) + 1
    return np.insert(both, breaks, -1).astype(np.int32), distinct.take(pa.array(word[first])), spoken[first]


def _relation(chunk: int, seq: np.ndarray, bucket: np.ndarray, order: np.ndarray, cell, counts: np.ndarray) -> list[dict]:
    """Rows of a chunk whose phrases are renumbered by bucket; ``cell`` packs the keys of a range."""
    number = np.empty(len(order) + 1, np.int32)
    number[order] = np.arange(len(order))
    number[-1] = -1  # a break
    rows = [{"chunk": chunk, "seq": squeeze(number[seq]), "length": len(seq)}]
    dealt, counts = bucket[order], counts[order]
    edges = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1], [True]]))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        rows.append(
            {"chunk": chunk, "bucket": int(dealt[low]), "base": low, "size": high - low, "counts": squeeze(counts[low:high]), **cell(low, high)}
        )
    return rows


def occurrence_chunks(docs: DataFrame) -> DataFrame:
    """The persisted relation of single words; a row without a chunk counts a chunk's words of a language."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text")
    )
    buckets = BUCKETS * parts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for part in grouped(batches, "text", CHUNK_BYTES):
            langs = part.column("lang").combine_chunks().dictionary_encode()
            seq, words, spoken = _occurrences(part.column("text"), langs.indices)
            if not len(seq):
                continue
            counts = np.bincount(seq[seq >= 0], minlength=len(words))
            names = langs.dictionary.cast(pa.large_binary())
            # words hold no line end, so the last one parts language and word
            keys = pc.binary_join_element_wise(names.take(pa.array(spoken)), words.cast(pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
            bucket = (hashes(keys) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            data, marks = text_bytes_of(keys.take(pa.array(order)))

            def cell(low: int, high: int) -> dict:
                body = data[marks[low] : marks[high]]
                return {"keys": zipped(body.tobytes()), "lengths": squeeze(np.diff(marks[low : high + 1]))}

            sums = np.bincount(spoken, weights=counts, minlength=len(names)).astype(np.int64)
            found = _relation(chunk, seq, bucket, order, cell, counts)
            found += [{"lang": name, "n": int(n)} for name, n in zip(langs.dictionary.to_pylist(), sums) if n]
            yield from _batch(_RELATION, found).to_batches()
            chunk += 1

    return written(rows.mapInArrow(run, _RELATION), "collocations-1", "none")


def grouped(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The same rows in tables of about ``limit`` bytes of ``column``, over the bounds of batches."""
    held, size = [], 0
    for part in pieces(batches, column, limit):
        more = int(text_bytes(part.column(column))[1][-1])
        if held and size + more > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(part)
        size += more
    if held:
        yield pa.Table.from_batches(held)


def _frequent(relation: DataFrame, least: int, size: int) -> DataFrame:
    """Phrases found ``least`` times or more, written: each chunk's own (``place``, ``ids``) and the
    phrases themselves (``id``, ``f`` and their words or parts).

    A bucket holds one entry for each chunk and phrase, so the largest phrase of a bucket is no
    larger than the number of chunks.
    """

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, sizes = key[0].as_py(), table.column("size").to_pylist()
        counts = np.concatenate([expand(c, n, np.int64) for c, n in zip(table.column("counts").to_pylist(), sizes)])
        if size == 1:
            lengths = [expand(c, n, np.int64) for c, n in zip(table.column("lengths").to_pylist(), sizes)]
            data = b"".join(
                unzipped(k, int(m.sum())) for k, m in zip(table.column("keys").to_pylist(), lengths)
            )
            marks = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            values = binary_array(marks, np.frombuffer(data, np.uint8))
        else:
            pairs = np.concatenate([expand(k, n, "V16") for k, n in zip(table.column("keys").to_pylist(), sizes)])
            values = binary_array(np.arange(len(pairs) + 1) * 16, pairs.view(np.uint8))
        number, distinct = numbered(values)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, number, counts)
        good = total >= least
        ids = (np.int64(bucket) << 32) + np.cumsum(good) - 1
        rows, low = [], 0
        for chunk, base, n in zip(table.column("chunk").to_pylist(), table.column("base").to_pylist(), sizes):
            here = number[low : low + n]
            at = np.flatnonzero(good[here])
            low += n
            if len(at):
                place = (at + base).astype(np.int32)
                rows.append({"chunk": chunk, "size": len(at), "place": squeeze(place), "ids": squeeze(ids[here[at]])})
        kept = distinct.filter(pa.array(good)).to_pylist()
        for name, f, phrase in zip(kept, total[good].tolist(), ids[good].tolist()):
            row = {"id": phrase, "f": f}
            if size == 1:
                lang, _, word = name.rpartition(b"\n")
                row |= {"lang": lang.decode(), "word": word.decode()}
            else:
                row["left"], row["right"] = np.frombuffer(name, np.int64).tolist()
            rows.append(row)
        return _batch(_FOUND, rows)

    cells = relation.where("bucket IS NOT NULL").select("bucket", "chunk", "base", "size", "keys", "lengths", "counts")
    return written(cells.groupBy("bucket").applyInArrow(count, _FOUND), f"collocations-found-{size}", "none")


def _extend(relation: DataFrame, found: DataFrame, keep_sequence: bool) -> DataFrame:
    """Merge-join neighbours of each chunk's frequent occurrences: the relation of the next length."""
    buckets = BUCKETS * parts(relation)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _batch(_RELATION, [])
        chunk = left.column("chunk")[0].as_py()
        seq = expand(left.column("seq")[0].as_py(), left.column("length")[0].as_py(), np.int32)
        sizes = right.column("size").to_pylist()
        place = np.concatenate([expand(p, n, np.int32) for p, n in zip(right.column("place").to_pylist(), sizes)])
        ids = np.concatenate([expand(p, n, np.int64) for p, n in zip(right.column("ids").to_pylist(), sizes)])
        number = np.full(max(int(seq.max()), int(place.max())) + 2, -1, np.int64)  # the last entry answers a break
        number[place] = np.arange(len(place))
        here = number[seq]
        at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
        if not len(at):
            return _batch(_RELATION, [])
        a, b = here[at], here[at + 1]
        pair = pair_ids(a, b)
        counts = np.bincount(pair)
        first = np.empty(len(counts), np.int64)
        first[pair[::-1]] = np.arange(len(pair))[::-1]
        keys = np.stack([ids[a[first]], ids[b[first]]], axis=1)
        bucket = (mix64(mix64(keys[:, 0]) + keys[:, 1].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((keys[:, 1], keys[:, 0], bucket))
        following = np.empty(0, np.int32)
        if keep_sequence:
            following = np.full(len(seq) - 1, -1, np.int32)
            following[at] = pair
            # one break in a row is enough
            following = following[(following >= 0) | np.concatenate([[True], following[:-1] >= 0])]
        keys = keys[order]
        rows = _relation(chunk, following, bucket, order, lambda low, high: {"keys": squeeze(keys[low:high])}, counts)
        return _batch(_RELATION, rows)

    sequences = relation.where("seq IS NOT NULL").select("chunk", "seq", "length")
    replies = found.where("chunk IS NOT NULL").select("chunk", "size", "place", "ids")
    return sequences.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(join, _RELATION)


def phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language, and per length from 1 the frequent phrases: ``id, left, right, f,
    lang, words, heads, tails``.

    ``left`` and ``right`` are the phrases without the last and the first word; ``heads[i]``
    and ``tails[i]`` count the first and the last ``i + 1`` words.  Parts of a frequent phrase are as
    frequent, so every count they need is there.  Written tables throughout.
    """
    relation = occurrence_chunks(docs)
    totals = relation.where("chunk IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    levels: list[DataFrame] = []
    for size in range(1, longest + 1):
        found = _frequent(relation, least, size)
        own = found.where("chunk IS NULL")
        if size == 1:
            one = F.array("f")
            level = own.select("id", "left", "right", "f", "lang", F.array("word").alias("words"), one.alias("heads"), one.alias("tails"))
        else:
            level = written(_spelled(own, levels[-1]), f"collocations-level-{size}")
        levels.append(level)
        if size < longest:
            relation = written(_extend(relation, found, size + 1 < longest), f"collocations-{size + 1}", "none")
    return totals, levels


def _spelled(found: DataFrame, parts: DataFrame) -> DataFrame:
    head = parts.select(F.col("id").alias("left"), "lang", F.col("words").alias("before"), F.col("heads").alias("h"))
    tail = parts.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"), F.col("tails").alias("t"))
    return (
        found.select("id", "left", "right", "f")
        .join(head, "left")
        .join(tail, "right")
        .select(
            "id", "left", "right", "f", "lang",
            F.concat("before", F.array("last")).alias("words"),
            F.concat("h", F.array("f")).alias("heads"),
            F.concat("t", F.array("f")).alias("tails"),
        )
    )


def _lowest_cut(size: int) -> Column:
    """``score, k, l, r`` of the cut with the lowest score, the earliest of equals.  Exact: counts
    below 10**15 keep all products within 38 digits."""

    def wide(value: Column) -> Column:
        return value.cast("decimal(15,0)")

    def score(k: int) -> Column:
        a, left, right = wide(F.col("f")), wide(F.col("heads")[k - 1]), wide(F.col("tails")[size - k - 1])
        top = (a * a * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
        return F.call_function("div", top, (left * right).cast("decimal(38,0)"))

    return F.array_min(
        F.array(
            *[
                F.struct(
                    score(k).alias("score"), F.lit(k).alias("k"), F.col("heads")[k - 1].alias("l"),
                    F.col("tails")[size - k - 1].alias("r"),
                )
                for k in range(1, size)
            ]
        )
    )


def collocations(
    docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS, share: int = SHARE, top: int = TOP
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words per language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase goes if a longer frequent one holds it and has ``share`` % of its count; counts
    shrink as phrases grow, so only those of one more word need be asked.

    A null language counts as ``und``, a null text as empty; repeated rows count as often as they
    occur; doc_id and further columns are not read; equal scores go by count, then bytes of the
    phrase.  No words or no frequent phrase: no rows.
    """
    totals, levels = phrases(docs, least, longest)
    out = None
    for size in range(2, longest + 1):
        level = levels[size - 1]
        if size < longest:
            longer = levels[size].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("of"))
            level = level.join(longer.groupBy("id").agg(F.max("of").alias("of")), "id", "left").where(
                F.coalesce(100 * F.col("of") < share * F.col("f"), F.lit(True))
            )
        scored = level.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), _lowest_cut(size).alias("cut"))
        out = scored if out is None else out.unionByName(scored)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = (
        out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score")
    )
