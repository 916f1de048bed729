import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opslens.llm import mixing


def water(sizes, weights, most=3.0):
    """Targets by resharing until none is above its cap."""
    target, free, rest = {}, dict(weights), float(sum(sizes.values()))
    while free:
        per = rest / sum(free.values())
        over = [s for s in free if free[s] * per > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: w * per for s, w in free.items()}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
            del free[s]
    return target


def sizes_of(rows):
    out = Counter()
    for r in rows:
        out[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    return out


@pytest.mark.parametrize("flight", [8, 64, 4096])
def test_targets_and_totals(small, flight):
    got = mixing.mix_report(small, flight_rows=flight).toPandas()
    docs = small.toPandas().set_index("doc_id")
    got["source"] = docs.source.reindex(got.doc_id).values
    sizes = sizes_of(small.collect())
    want = water(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
    for source, rows in got.groupby("source"):
        assert rows.source_size.iloc[0] == sizes[source] == rows["size"].sum()
        assert rows.target.iloc[0] == pytest.approx(want[source])
        # a few documents a source: within the largest one
        assert abs(rows.taken.sum() - want[source]) <= rows["size"].max() + 1
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.takes * got["size"]).all()


def test_large_source_is_near_its_target(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', cast(1 + pow(id % 97, 2) / 20 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"),
    )
    got = mixing.mix_report(rows, flight_rows=256).toPandas()
    docs = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((docs.taken - docs.target).abs() < 0.01 * docs.target).all()


def test_reruns_agree(small):
    first, second = (
        mixing.mix_report(small.repartition(n), flight_rows=16).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (2, 5)
    )
    assert first.equals(second)


def test_a_capped_source(spark):
    rows = [(i, "w " * 10, "a") for i in range(50)] + [(100, "w w w", "b"), (101, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    assert got[100].target == 9 and got[100].taken == 9
    assert got[101].target == 3 and got[101].taken == 3
    assert got[0].target == 504 - 12


def test_odd_rows(odd, none):
    got = mixing.mix_report(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(
        (r.doc_id is None, r.doc_id or 0) for r in odd.select("doc_id").collect()
    )
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    takes = {r.takes for r in got if r.doc_id == 6}
    assert len(takes) == 1
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.takes for r in got)
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_flight_keeps_totals():
    import random

    draw = random.Random(5)
    rows = sorted(((draw.random(), draw.randint(1, 500)) for _ in range(400)), key=lambda r: -r[1])
    flight = mixing.Flight("x", last=False)
    settled = {}
    for i, (p, s) in enumerate(rows):
        settled.update(flight.add(i, p, s))
    left = {i: p for i, p, _ in flight.held}
    assert len(left) <= 2 and set(settled.values()) <= {0.0, 1.0}
    every = settled | left
    assert sum(every.values()) == pytest.approx(sum(p for p, _ in rows))
    assert sum(every[i] * s for i, (_, s) in enumerate(rows)) == pytest.approx(sum(p * s for p, s in rows))
