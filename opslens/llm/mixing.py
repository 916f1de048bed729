"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words.  A document is taken ``floor(ratio)``
times for sure, and once more with probability ``ratio - floor(ratio)``, where
``ratio`` is its source's target over its source's size.  The extra takes are drawn
by the cube method: the probabilities walk through the null space of the balancing
constraints (documents and words of the source), so that both totals stay exactly
what they were until only two documents of a source are undecided; these few are
landed on the values nearest to the totals.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.shared import join_small, parts, written
from opslens.llm.words import WORD

#: Documents of one flight; larger sources fly in several groups, whose rests fly again.
FLIGHT_ROWS = 4096
MOST_TAKES = 3
TINY = 1e-9
STEEP = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(units: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = MOST_TAKES) -> DataFrame:
    """Target words per source: ``source, source_size, target`` from ``source, words``.

    Sources in code point order, null last, weigh ``weights`` in turn and share all
    words; a target stops at ``most`` times its source's size, and what is over is
    shared again by weight until none is above.  Works on one row per source.
    """
    sums = units.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("rows"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    rows = sums.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    order = [F.col("level").asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn(
        "share",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    free = F.col("share") < F.col("level")
    # the first source below its cap fixes the words per weight of all later ones
    per_weight = F.min_by(F.when(free, F.col("share")), F.when(free, F.col("level"))).over(everything)
    target = F.when(free, F.least(F.col("weight") * per_weight, F.col("cap"))).otherwise(F.col("cap"))
    return rows.select("source", "source_size", F.col("rows"), target.alias("target"))


def _step(p: np.ndarray, a: np.ndarray, draw: random.Random) -> np.ndarray:
    """Move three probabilities along the null direction of two constraints until one is 0 or 1."""
    u = np.cross(a[0], a[1])
    if not np.abs(u).max() > TINY:  # three equal sizes
        u = np.array([1.0, -1.0, 0.0])
    u = u / np.abs(u).max()
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > TINY, (1 - p) / u, np.where(u < -TINY, p / -u, np.inf)).min()
        down = np.where(u > TINY, p / u, np.where(u < -TINY, (1 - p) / -u, np.inf)).min()
    moved = p + up * u if draw.random() * (up + down) < down else p - down * u
    moved[moved < TINY] = 0.0
    moved[moved > 1 - TINY] = 1.0
    return moved


class Flight:
    """One group's flight: rows go in by decreasing words, decided rows come out.

    Beside small documents a large undecided one hardly moves and would be left for the
    end.  The last round therefore lands it as soon as the next documents have a quarter of its
    words, and these take up the words it was over or short.
    """

    def __init__(self, seed: str, last: bool):
        self.draw = random.Random(seed)
        self.last = last
        self.over = 0.0  # words taken by landed rows beyond their probabilities
        self.held: list[tuple[int, float, float]] = []  # row, probability, words

    def add(self, row: int, p: float, words: float) -> list[tuple[int, float]]:
        settled = []
        if self.last:
            for early in [h for h in self.held if h[2] > STEEP * words]:
                taken = float(self.draw.random() < early[1])
                self.over += (taken - early[1]) * early[2]
                self.held.remove(early)
                settled.append((early[0], taken))
            if self.over and words:
                shifted = min(1.0, max(0.0, p - self.over / words))
                self.over -= (p - shifted) * words
                p = shifted
                if p in (0.0, 1.0):
                    return [*settled, (row, p)]
        self.held.append((row, p, words))
        if len(self.held) < 3:
            return settled
        rows, probabilities, sizes = zip(*self.held)
        moved = _step(np.array(probabilities), np.array([[1.0] * 3, sizes]), self.draw)
        settled += [(r, float(p)) for r, p in zip(rows, moved) if p in (0.0, 1.0)]
        self.held = [(r, float(p), s) for r, p, s in zip(rows, moved, sizes) if p not in (0.0, 1.0)]
        return settled

    def land(self) -> list[tuple[int, float]]:
        """Settle the rest on the outcome nearest to the words still due, then to the documents."""
        words = sum(p * s for _, p, s in self.held) - self.over
        count = sum(p for _, p, _ in self.held)
        outcomes = [
            tuple((bits >> i) & 1 for i in range(len(self.held))) for bits in range(1 << len(self.held))
        ]
        best = min(
            outcomes,
            key=lambda o: (abs(sum(x * h[2] for x, h in zip(o, self.held)) - words), abs(sum(o) - count), o),
        )
        return [(h[0], float(x)) for h, x in zip(self.held, best)]


def _fly(level: int, last: bool):
    """Flights over a partition sorted by group; state is three rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, group, waiting = None, None, {}

        def take(decided):
            return [waiting.pop(number) | {"p": p} for number, p in decided]

        def close():
            return take(flight.land() if last else [(number, p) for number, p, _ in flight.held])

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                here = (row["source"], row["bucket"])
                if flight is None or here != group:
                    done += close() if flight else []
                    flight, group, number = Flight(f"{level}/{here[0]!r}/{here[1]}", last), here, 0
                waiting[number] = row
                done += take(flight.add(number, row["p"], float(row["words_all"])))
                number += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=batch.schema)
        if flight is not None:
            yield pa.RecordBatch.from_pylist(close(), schema=batch.schema)

    return run


def flights(units: DataFrame, flight_rows: int = FLIGHT_ROWS) -> DataFrame:
    """Settle ``p`` of every unit to 0 or 1, keeping documents and words per source.

    Needs ``source, words, words_all, p, key`` (a stable text).  Groups of about ``flight_rows``
    fly in parallel; at most two units of each group are left, which fly again in the next
    round, so the rounds are the logarithm of the largest source.  A large source keeps a few
    hundred hashed units back for the last round, where small ones even out the large.
    """
    open_p = (F.col("p") > TINY) & (F.col("p") < 1 - TINY)
    settled = [units.where(~open_p)]
    rest = units.where(open_p)
    kept_back = None
    level = 0
    while True:
        sizes = rest.groupBy("source").agg(F.count("*").alias("__rows"))
        last = (sizes.agg(F.max("__rows")).first()[0] or 0) <= flight_rows
        if last and kept_back is not None:
            rest = rest.unionByName(kept_back)
        buckets = F.lit(1) if last else F.ceil(F.col("__rows") / flight_rows).cast("bigint")
        sized = join_small(
            rest, sizes.withColumnRenamed("source", "__source"), F.expr("source <=> __source")
        ).withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(level)), F.coalesce(buckets, F.lit(1))))
        if not level and not last:
            share = F.greatest(F.lit(1), F.floor(F.col("__rows") * 8 / flight_rows))
            back = (F.col("__rows") > flight_rows) & (F.pmod(F.xxhash64("key", F.lit("back")), share) == 0)
            kept_back = sized.where(back).select(*units.columns)
            sized = sized.where(~back)
        flown = (
            sized.select(*units.columns, "bucket")
            .repartition(parts(units), "source", "bucket")
            .sortWithinPartitions("source", "bucket", F.desc("words_all"), "key")
        )
        # large documents first, so that those left at the end are small
        flown = written(flown.mapInArrow(_fly(level, last), flown.schema).drop("bucket"), f"mix-{level}")
        if last:
            settled.append(flown)
            return reduce(DataFrame.unionByName, settled)
        settled.append(flown.where(~open_p))
        rest = flown.where(open_p)
        level += 1


def _unit_key() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        F.col("doc_id").cast("string").alias("unit_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(text).alias("unit_text"),
        F.col("text").isNull().alias("unit_null"),
    ]


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = MOST_TAKES, flight_rows: int = FLIGHT_ROWS
) -> DataFrame:
    """How often each unit is taken.  A unit is the set of rows with equal id, source and text;
    its ``n`` rows are taken equally often (``takes``), so a repeated row costs no more than one.
    """
    units = docs.select(*_unit_key(), word_count(F.col("text")).alias("words"))
    units = units.groupBy("unit_id", "source", "unit_text", "unit_null", "words").agg(F.count("*").alias("n"))
    units = units.withColumn("words_all", F.col("words") * F.col("n"))
    units = written(units, "mix-units")
    targets = source_targets(units.select("source", F.col("words_all").alias("words"), "n"), weights, most)
    targets = written(targets.withColumnRenamed("source", "target_source"), "mix-targets")
    rows = join_small(units, targets.drop("rows"), F.expr("source <=> target_source")).drop("target_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.least(F.floor(ratio + TINY), F.lit(int(most)))
    rows = rows.withColumn("sure", sure.cast("int")).withColumn("p", F.greatest(ratio - F.col("sure"), F.lit(0.0)))
    key = F.concat_ws("/", F.coalesce("unit_id", F.lit("~")), F.col("unit_text").cast("string"), F.col("unit_null").cast("string"))
    flown = flights(rows.withColumn("key", key), flight_rows)
    return flown.select(
        "unit_id",
        "source",
        "unit_text",
        "unit_null",
        "words",
        "n",
        "source_size",
        "target",
        (F.col("sure") + (F.col("p") > 0.5).cast("int")).alias("takes"),
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document row: ``doc_id, size, source_size, target, taken, takes``.

    ``taken`` counts the words of the row's takes.  Null and empty texts have size 0 and
    take 0 words; a null source is a source of its own, last in order; an empty table gives no
    rows.  Runs agree: draws depend on the rows alone.
    """
    plan = plan_mix(docs, **options)
    kind = docs.schema["doc_id"].dataType
    return plan.select(
        F.col("unit_id").cast(kind).alias("doc_id"),
        F.col("words").alias("size"),
        "source_size",
        "target",
        (F.col("words") * F.col("takes")).alias("taken"),
        "takes",
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
    ).drop("copy")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with its own columns.

    Null and empty texts have no words and are taken as their source's share says; a null source is a source of
    its own; of repeated rows each is taken as often as the others; columns of any name pass through; an
    empty table gives no rows.
    """
    parts_ = ("unit_id", "source", "unit_text", "unit_null")
    plan = plan_mix(docs, **options).where("takes > 0")
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in (*parts_, "takes")])
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    marked = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[key.alias(f"__m_{n}") for key, n in zip(_unit_key(), parts_)]
    )
    same = [F.col(f"__m_{c}").eqNullSafe(F.col(f"__{c}")) for c in parts_]
    joined = marked.join(plan, same[0] & same[1] & same[2] & same[3])
    often = joined.select(*names.values(), F.explode(F.sequence(F.lit(1), F.col("__takes"))).alias("__take"))
    return often.select(*[F.col(n).alias(c) for c, n in names.items()])
