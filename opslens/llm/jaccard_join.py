"""Similarity join on n-gram sets: rare-first prefix filter, one verification per pair.

Two documents link when the Jaccard similarity of their shingle sets reaches ``percent``.

1. One pass hashes every set, digests it, keeps a parity signature, and counts shingles in a
   sketch of fixed size.  Documents with equal sets form a class and count once from here on.
2. Shingles are ordered rare first by the sketch (any fixed order is right; rare ones first keep
   groups small).  Two linked sets share a shingle within their prefixes of
   ``n - ceil(n * percent / 100) + 1``, so only prefixes meet, by shingle.
3. In a shingle's group, sorted by set size, each document is a candidate with the leader, the first
   one that the length filter lets it link to, if the positional filter allows.  The suffix filter drops
   those whose signatures differ in more places than linked sets may differ in.  Of the others each
   document's best one, by shared prefix, is verified.
4. Groups that still hold several components are compared block by block, across components only
   and through all filters: each document with its nearest by signature, round after round while that
   links components, then all that is still apart.  A large group of near copies costs its length and not
   its square, and no link between components is lost.  The first of these rounds reads all groups; it
   keeps the rows that pass the filters with another component, and the others read only these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.components import components
from opslens.llm.shared import batch_bytes, bitmap, discard, in_bitmap, parts, spot_of, written
from opslens.llm.words import WORD, Words, hashes, mix64, pieces

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 20
SKETCH_BLOCKS = 64
#: A shingle with so many documents in the sketch is dealt to several tasks.
HOT = 20_000
#: Members of one block in the comparison across components.
BLOCK = 2_000
LEAST_SIGNATURE = 1024
BITMAP_BITS = 26
#: Bytes of rows that a task is sent, and of texts or packed sets that it handles, at once.
HELD_BYTES = 1 << 20
#: Most rounds of nearest documents; what they leave apart is compared in full.
NEAREST_ROUNDS = 12
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` as a task that gives back what Arrow's pool keeps after each batch: a worker waits for later
    tasks with no more than it needs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in run(batches):
            yield batch
            del batch
            pool.release_unused()
        pool.release_unused()

    return task


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a short text is one shingle, a wordless one has none."""
    words = Words(column, lower=True)
    ids, distinct = words.ids()
    value = hashes(distinct)[ids] if len(ids) else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = value.copy()
        for k in range(1, min(size, len(value))):
            rolled[:-k] = rolled[:-k] * _FACTORS[k % 4] + value[k:]
        rolled = mix64(rolled)
    out = []
    for start, end in zip(words.first[:-1], words.first[1:]):
        if end - start >= size:
            found = np.sort(rolled[start : end - size + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif end > start:
            one = np.uint64(end - start)
            with np.errstate(over="ignore"):
                for v in value[start:end]:
                    one = one * _FACTORS[1] + v
            out.append(mix64(np.array([one ^ _FACTORS[0]])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def least_overlap(a, b, percent: int):
    """Shared shingles that sets of these sizes need: inter * 100 >= percent * (a + b - inter)."""
    return -(-percent * (a + b) // (100 + percent))


def signature(found: np.ndarray) -> bytes:
    """Parity of the hashes per slot, four to eight slots a shingle."""
    bits = max(LEAST_SIGNATURE, 4 << int(np.ceil(np.log2(max(len(found), 1)))))
    return np.packbits(np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the sets' symmetric difference: differing slots, the longer signature folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


_FACTS = "doc_id bigint, n bigint, d1 bigint, d2 bigint, signature binary, block int, counts binary"


def _facts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FACTS.split(", ")]
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in pieces(batches, "text", HELD_BYTES):
            sets = shingle_sets(batch.column("text"), size)
            count = len(sets)
            if sum(map(len, sets)):
                every = np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1)
                sketch += np.bincount(every.astype(np.int64), minlength=len(sketch))
            with np.errstate(over="ignore"):
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([np.bitwise_xor.reduce(mix64(s + _FACTORS[1])) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(d1),
                    pa.array(d2.view(np.int64)),
                    pa.array([signature(s) for s in sets], pa.binary()),
                    pa.nulls(count, pa.int32()),
                    pa.nulls(count, pa.binary()),
                ],
                names,
            )
        blocks = np.minimum(sketch, (1 << 31) - 1).astype("<i4").reshape(SKETCH_BLOCKS, -1)
        full = [i for i in range(SKETCH_BLOCKS) if blocks[i].any()]
        nothing = [pa.nulls(len(full), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*nothing, pa.array(full, pa.int32()), pa.array([blocks[i].tobytes() for i in full], pa.binary())], names
        )

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            one = np.frombuffer(counts, "<i4").astype(np.int64)
            sums[block] = np.minimum(sums.get(block, 0) + one, (1 << 31) - 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([v.astype("<i4").tobytes() for v in sums.values()], pa.binary())],
        ["block", "counts"],
    )


def sketch_of(facts: DataFrame) -> np.ndarray:
    """Documents per sketch slot: the tasks' blocks are added up where they lie, then in a few tasks.  4 MB in all."""
    rows = facts.where("block IS NOT NULL").select("block", "counts")
    few = rows.mapInArrow(_add_blocks, "block int, counts binary")
    total = few.repartition(8, "block").mapInArrow(_add_blocks, "block int, counts binary").toArrow()
    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int32)
    for block, counts in zip(total.column("block").to_pylist(), total.column("counts").to_pylist()):
        out[block] = np.frombuffer(counts, "<i4")
    return out.reshape(-1)


_PREFIX = "token bigint, salt int, doc_id bigint, n int, place int, d1 bigint"


def _prefixes(size: int, percent: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value
        seen: set[tuple[int, int]] = set()
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in pieces(batches, "text", HELD_BYTES):
            out = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), size)):
                n = len(found)
                if not n or doc_id is None:
                    continue
                with np.errstate(over="ignore"):
                    d1 = int(found.sum(dtype=np.uint64).view(np.int64))
                if (d1, n) in seen:  # an equal set stands for this one in the task
                    continue
                seen.add((d1, n))
                count = n - -(-n * percent // 100) + 1
                often = sketch[(found & mask).astype(np.int64)]
                if count < n // 2:  # only the rarest matter; ties go by hash, as found is sorted
                    least = np.partition(often, count - 1)[count - 1]
                    near = np.flatnonzero(often <= least)
                    order = near[np.argsort(often[near], kind="stable")][:count]
                else:
                    order = np.argsort(often, kind="stable")[:count]
                often = often[order]
                # salts of hot shingles count from 1: only a shingle with salt 0 lies in one task
                salt = np.where(often >= HOT, 1 + doc_id % (1 + often.astype(np.int64) // HOT), 0)
                out.append((found[order].view(np.int64), salt, doc_id, n, d1))
            if not out:
                continue
            sizes = [len(o[0]) for o in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([o[0] for o in out])),
                    pa.array(np.concatenate([o[1] for o in out]).astype(np.int32)),
                    pa.array(np.repeat([o[2] for o in out], sizes), pa.int64()),
                    pa.array(np.repeat([o[3] for o in out], sizes), pa.int32()),
                    pa.array(np.concatenate([np.arange(s) for s in sizes]), pa.int32()),
                    pa.array(np.repeat([o[4] for o in out], sizes), pa.int64()),
                ],
                [c.split()[0] for c in _PREFIX.split(", ")],
            )

    return run


_RUNS = "token bigint, salt int, doc_id bigint, n int, place int, leader bigint"


def _passes(n1, place1, n2, place2, percent: int):
    """Length and positional filter for sizes n1 <= n2."""
    fits = n1 * 100 >= n2 * percent
    rest = 1 + np.minimum(n1 - 1 - place1, n2 - 1 - place2)
    return fits & (rest >= least_overlap(n1, n2, percent))


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows regrouped so that no run of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = not held or any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns))
        cuts = np.flatnonzero(change)
        if len(cuts):
            last = int(cuts[-1])
            ready = [*held, batch.slice(0, last)] if last else held
            if ready:
                yield pa.Table.from_batches(ready)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _runs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, ["token", "salt"]):
            token, salt, doc, n, place, d1 = (table.column(c).to_numpy() for c in ("token", "salt", "doc_id", "n", "place", "d1"))
            # sorted by token, salt, n, d1, doc: equal sets stand together, the first one stays
            same_run = np.zeros(len(token), bool)
            same_run[1:] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            copy = np.zeros(len(token), bool)
            copy[1:] = same_run[1:] & (d1[1:] == d1[:-1]) & (n[1:] == n[:-1])
            token, salt, doc, n, place = (c[~copy] for c in (token, salt, doc, n, place))
            same = np.zeros(len(token) + 1, bool)
            same[1:-1] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            shared = same[:-1] | same[1:] | (salt > 0)
            lead = np.arange(len(token))
            starts = np.flatnonzero(~same[:-1] & same[1:])
            ends = np.flatnonzero(same[:-1] & ~same[1:]) + 1
            for start, end in zip(starts.tolist(), ends.tolist()):
                while start < end:  # the first of a run leads all that the length filter lets link to it
                    stop = start + int(np.searchsorted(n[start:end], n[start] * 100 // percent, "right"))
                    lead[start:stop] = start
                    start = stop
            leads = (doc[lead] != doc) & _passes(n[lead], place[lead], n, place, percent)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(c[shared]) for c in (token, salt, doc, n, place)],
                    pa.array(doc[lead][shared], mask=~leads[shared]),
                ],
                [c.split()[0] for c in _RUNS.split(", ")],
            )

    return run


def _like(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "sig_b", HELD_BYTES):
            kept = [
                differing(x, y) <= a + b - 2 * least_overlap(a, b, percent)
                for x, y, a, b in zip(*(batch.column(c).to_pylist() for c in ("sig_a", "sig_b", "na", "nb")))
            ]
            yield batch.select(["a", "b", "shared"]).filter(pa.array(kept, pa.bool_()))

    return run


def _spotted(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(sent.value, batch.column("spot").to_numpy()))).select(names)

    return run


def _ends(pairs: DataFrame, sent: list[Broadcast] | None) -> Broadcast:
    """A bitmap of the pairs' documents, sent to all tasks and noted in ``sent``."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    ends = pairs.sparkSession.sparkContext.broadcast(bitmap(ids, "doc_id", BITMAP_BITS))
    if sent is not None:
        sent.append(ends)
    return ends


def _forget(sent: list[Broadcast]) -> None:
    """Take what was sent from the executors, once the tables that needed it are written."""
    while sent:
        sent.pop().unpersist()


def suffix_filter(pairs: DataFrame, rows: DataFrame, percent: int, sent: list[Broadcast] | None = None) -> DataFrame:
    """Pairs ``a, b, shared`` (a written table) whose signatures differ no more than linked sets may.

    Signatures travel for the pairs' documents alone.  Rows that share an id and differ in text are compared
    in every version."""
    spots = rows.select("doc_id", "n", "signature", spot_of("doc_id", BITMAP_BITS).alias("spot"))
    found = spots.mapInArrow(_lean(_spotted(_ends(pairs, sent), ["doc_id", "n", "signature"])), "doc_id bigint, n bigint, signature binary")
    signatures = found.repartition(parts(rows), "doc_id").distinct()
    side = lambda k: signatures.select(
        F.col("doc_id").alias(k), F.col("signature").alias(f"sig_{k}"), F.col("n").alias(f"n{k}")
    )
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(_lean(_like(percent)), "a bigint, b bigint, shared bigint")


def _sets(size: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(sent.value, batch.column("spot").to_numpy())))
            for piece in pieces([batch], "text", HELD_BYTES):
                sets = shingle_sets(piece.column("text"), size)
                # six bytes a shingle: two sets of thousands meet by chance once in 10**8 pairs
                packed = [np.sort(s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "n", "packed"],
                )

    return run


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "set_b", HELD_BYTES):  # a batch of Arrow's has rows of any length
            kept = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = _unpacked(x), _unpacked(y)
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                kept.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int, sent: list[Broadcast] | None = None) -> DataFrame:
    """The pairs that link.  Sets are made for the pairs' documents alone (found by bitmap), once a document.

    Also few pairs meet by shuffle: a broadcast join would leave making and comparing sets in one task, and
    every core with two Python workers instead of one."""
    ends = _ends(pairs, sent)
    rows = _ready(docs).withColumn("spot", spot_of("doc_id", BITMAP_BITS))
    sets = rows.where("doc_id IS NOT NULL").mapInArrow(_lean(_sets(size, ends)), "doc_id bigint, n bigint, packed binary")
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("packed").alias(f"set_{k}"))
    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return joined.mapInArrow(_lean(_verified(percent)), "a bigint, b bigint").distinct()


def _ready(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _shorts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures folded to the least size."""
    size = LEAST_SIGNATURE // 8
    for batch in batches:
        folded = [
            np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0).tobytes()
            for x in batch.column("signature").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(folded, pa.binary())], ["doc_id", "short"])


_LIVE = ["token", "doc_id", "n", "place", "short"]
_FOUND = "token bigint, doc_id bigint, n int, place int, short binary, a bigint, b bigint"


def _across(percent: int, nearest: bool):
    """Pairs ``a, b`` of one group, in different components, that pass the length and positional filters and the
    suffix filter with the short signature; with ``nearest`` only each document's nearest by signature.
    Then the rows of all pairs that pass (the live ones), also of those not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n", "place", "component", "part", "low", "high")
        for table in _whole_runs(batches, ["token", "low", "high"]):
            token = table.column("token").to_numpy()
            doc, n, place, component, part, low, high = (table.column(c).to_numpy() for c in names)
            short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(len(doc), -1)
            edge = np.flatnonzero(
                np.concatenate([[True], (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]])
            )
            found: set[tuple[int, int]] = set()
            best: dict[int, tuple[int, int]] = {}
            live = np.zeros(len(doc), bool)
            for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for i in range(start, end - 1):  # rows are sorted by n
                    stop = start + int(np.searchsorted(n[start:end], n[i] * 100 // percent, "right"))
                    j = np.arange(i + 1, max(stop, i + 1))
                    good = (component[j] != component[i]) & _passes(n[i], place[i], n[j], place[j], percent)
                    if low[i] != high[i]:
                        good &= part[j] != part[i]
                    j = j[good]
                    if not len(j):
                        continue
                    apart = np.bitwise_count(short[j] ^ short[i]).sum(axis=1)
                    near = apart <= n[i] + n[j] - 2 * least_overlap(n[i], n[j], percent)
                    live[i] |= near.any()
                    live[j[near]] = True
                    a = int(doc[i])
                    for b, gap in zip(doc[j[near]].tolist(), apart[near].tolist()):
                        if not nearest:
                            found.add((min(a, b), max(a, b)))
                            continue
                        for x, y in ((a, b), (b, a)):
                            if x not in best or (gap, y) < best[x]:
                                best[x] = (gap, y)
            found |= {(min(x, y), max(x, y)) for x, (_, y) in best.items()}
            if found:
                ends = [pa.array(side, pa.int64()) for side in zip(*sorted(found))]
                fields = [table.schema.field(name) for name in _LIVE]
                nothing = [pa.nulls(len(found), f.type) for f in fields]
                yield pa.RecordBatch.from_arrays([*nothing, *ends], [*_LIVE, "a", "b"])
                for batch in table.select(_LIVE).filter(pa.array(live)).to_batches():
                    nothing = [pa.nulls(batch.num_rows, pa.int64())] * 2
                    yield pa.RecordBatch.from_arrays([*batch.columns, *nothing], [*_LIVE, "a", "b"])

    return run


def _between_components(runs: DataFrame, labels: DataFrame, shorts: DataFrame | None, percent: int, nearest: bool) -> DataFrame:
    """Candidates between components and live rows: shingles whose documents lie in several components, in blocks
    of ``BLOCK`` members.  Live rows bring their short signatures, others take them from ``shorts``."""
    rows = runs.select("token", "doc_id", "n", "place", *([] if shorts is not None else ["short"])).join(labels, "doc_id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc_id"))
    mixed = rows.groupBy("token").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("members")
    )
    mixed = mixed.where("least < most").select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(mixed, "token").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.join(shorts, "doc_id") if shorts is not None else rows
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.select("token", "doc_id", "n", "place", "component", "part", "short", F.explode(other).alias("other"))
    rows = rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")
    dealt = rows.repartition(parts(runs), "token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "doc_id")
    return dealt.mapInArrow(_lean(_across(percent, nearest)), _FOUND)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def similarity_join(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document row.

    A component is what links reach; its id is the least doc_id in it.  Wordless, empty and null texts
    have no shingles and are alone.  Rows of one doc_id are one node: they share a component.
    A row without id takes its set's component, or null.  Repeated rows are returned as often as they occur;
    an empty table gives no rows.
    """
    with batch_bytes(docs.sparkSession, HELD_BYTES):
        return _joined(docs, percent, size)[0]


def _joined(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``similarity_join``, and the written tables it is read from."""
    ready = _ready(docs)
    facts = written(ready.mapInArrow(_lean(_facts(size)), _FACTS), "join-facts")
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_of(facts))
    rows = facts.where("block IS NULL").select("doc_id", "n", "d1", "d2", "signature")
    classes = rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    classes = written(classes.where("members > 1 AND rep IS NOT NULL"), "join-classes")
    same = rows.join(classes, ["d1", "d2", "n"]).where("doc_id <> rep").select(*_ordered(F.col("doc_id"), F.col("rep")))

    prefixes = ready.mapInArrow(_lean(_prefixes(size, percent, sketch)), _PREFIX)
    dealt = prefixes.repartition(parts(docs), "token", "salt").sortWithinPartitions("token", "salt", "n", "d1", "doc_id")
    runs = written(dealt.mapInArrow(_lean(_runs(percent)), _RUNS), "join-runs")
    signed = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "signature")

    # a document is tried with the leader that shares most of its prefix ...
    led = runs.where("leader IS NOT NULL").groupBy(*_ordered(F.col("doc_id"), F.col("leader")))
    led = written(led.agg(F.count("*").alias("shared")), "join-led")
    sent = [sketch]
    likely = suffix_filter(led, signed, percent, sent)
    first = likely.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    tried = written(first, "join-first")
    links = written(verify(docs, tried, size, percent, sent).unionByName(same), "join-links")
    _forget(sent)
    spent = [runs, led, tried, links]
    # ... then with the nearest in other components, as long as that links some, and at last with all in these
    shorts = signed.mapInArrow(_lean(_shorts), "doc_id bigint, short binary").repartition(parts(docs), "doc_id").distinct()
    live, labels, nearest, number = runs, components(links), True, 0
    while True:
        found = _between_components(live, labels, None if number else shorts, percent, nearest)
        found = written(found, f"join-across-{number}")
        live = found.where("a IS NULL").select(*_LIVE).distinct()
        pairs = found.where("a IS NOT NULL").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs.withColumn("shared", F.lit(1).cast("bigint")), f"join-pairs-{number}")
        spent += [found, pairs]
        fresh = not pairs.isEmpty()
        if fresh:
            now = written(suffix_filter(pairs, signed, percent, sent).select("a", "b").distinct(), f"join-tried-{number}")
            new = written(verify(docs, now, size, percent, sent), f"join-links-{number}")
            _forget(sent)
            tried, links = tried.unionByName(now), links.unionByName(new)
            spent += [now, new]
            fresh = not new.isEmpty()
        if fresh:
            spent.append(labels)
            labels = components(links)
        if not nearest or found.isEmpty():
            break
        number += 1
        nearest = fresh and number < NEAREST_ROUNDS
    discard(*spent)

    named = rows.select("doc_id", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left")
    own = named.withColumn("node", F.coalesce("doc_id", "rep"))
    found = own.join(labels.withColumnRenamed("doc_id", "node"), "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")), [facts, classes, labels]


def keep_first(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One document of each component, with all its columns: the one with the least id.

    Documents without shingles are alone and all stay; so do rows without id.  Of several rows with the kept
    id and words in their texts, the one whose text has the least hash stays.
    """
    with batch_bytes(docs.sparkSession, HELD_BYTES):
        joined, spent = _joined(docs, percent, size)
    found = joined.where("n_shingles > 0 AND doc_id IS NOT NULL")
    found = written(found.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("rows")), "join-groups")
    discard(*spent)
    gone = found.where("doc_id <> first").select(F.col("doc_id").alias("__gone"))
    again = found.where("doc_id = first AND rows > 1").select(F.col("doc_id").alias("__gone"))
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # columns of any name pass through
    wordless = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD)
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("doc_id").alias("__id"), wordless.alias("__wordless")
    )
    kept = rows.join(gone, F.expr("__id = __gone AND NOT __wordless"), "left_anti")
    if not again.isEmpty():
        once = kept.where("NOT __wordless").join(again, F.expr("__id = __gone"), "left_semi")
        text = F.col(names["text"])
        rank = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64(text), text))
        once = once.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
        kept = kept.join(again, F.expr("__id = __gone AND NOT __wordless"), "left_anti").unionByName(once)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
