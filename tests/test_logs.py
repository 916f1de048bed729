"""Ordered and counting log operators against plain Python."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from opslens.functions import logline as L
from opslens.functions import text as T
from opslens.operators import logs as ops
from opslens.operators import ordered as O


def plain_windows(times, span):
    start, out = None, {}
    for t in sorted(times):
        if start is None or t >= start + span:
            start = t
        out[t] = start
    return out


@pytest.mark.parametrize("seed,step,block", [(1, 40, 1000), (2, 900, 3000), (3, 3, 1000), (4, 5000, 1000), (5, 333, 2500)])
def test_anchored_windows(spark, seed, step, block):
    rng = random.Random(seed)
    rows, now = [], {"hot": 5_000_000, "cold": 5_000_400}
    for n in range(600):
        key = "hot" if rng.random() < 0.8 else "cold"
        now[key] += rng.randint(0, step)
        rows.append((key, n, now[key]))
    df = spark.createDataFrame(rows, "source string, line_no bigint, ts_ms bigint")
    got = ops.rate_limit_anchored(df, 2, block=block).collect()
    assert len(got) == len(rows)
    for key in now:
        windows = plain_windows([t for k, _, t in rows if k == key], 1000)
        used = {}
        want = {}
        for k, n, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            w = windows[t]
            used[w] = used.get(w, 0) + 1
            want[n] = (w, used[w] <= 2)
        assert {r.line_no: (r.window_start, r.admitted) for r in got if r.source == key} == want


def test_aligned_limit_on_one_crowded_second(spark):
    df = spark.range(500).select(F.lit("a").alias("source"), F.col("id").alias("line_no"), F.lit(1234).alias("ts_ms"))
    flagged = ops.rate_limit_aligned(df, 10).where("admitted").select("line_no").collect()
    assert sorted(r.line_no for r in flagged) == list(range(10))


def test_limit_zero_admits_all(spark):
    df = spark.range(50).select(F.lit("a").alias("source"), F.col("id").alias("line_no"), F.lit(1234).cast("bigint").alias("ts_ms"))
    assert ops.rate_limit_aligned(df, 0).where("admitted").count() == 50
    assert ops.rate_limit_anchored(df, 0).where("admitted").count() == 50


def plain_rotation(sizes, room, header):
    number, used, out = 0, header, []
    for size in sizes:
        if used + size > room:
            number, used = number + 1, header
        used += size
        out.append(number)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rotation_plan(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([5, 20, 60, 150]) for _ in range(200)]
    rows = [("o", "20260101", i, s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "output string, day string, seq bigint, bytes bigint")
    for block in (1, 7, 50, 1_000_000):
        got = ops.size_rotation_plan(df, 100, 10, block).orderBy("seq").collect()
        assert [r.file_no for r in got] == plain_rotation(sizes, 100, 10)
    files = {}
    for r in got:
        files.setdefault(r.file_no, []).append(r.bytes)
    assert all(10 + sum(lines) <= 100 or len(lines) == 1 for lines in files.values())


def test_rotation_without_header(spark):
    rows = [("o", "d", i, s) for i, s in enumerate([150, 20, 90, 150, 150, 5])]
    df = spark.createDataFrame(rows, "output string, day string, seq bigint, bytes bigint")
    for block in (1, 2, 100):
        got = ops.size_rotation_plan(df, 100, 0, block).orderBy("seq").collect()
        assert [r.file_no for r in got] == [0, 1, 2, 3, 4, 5]


def test_rotation_in_rounds(spark, monkeypatch):
    """No task holds the summaries of a whole output: few per key at the top, each with one file's lines."""
    monkeypatch.setattr(O, "FAN", 3)
    store, levels = O.stored, []
    monkeypatch.setattr(O, "stored", lambda *a: levels.append(store(*a)) or levels[-1])
    rng = random.Random(8)
    rows = [(f"o{k}", "d", i - 5, rng.choice([5, 20, 60, 150])) for k, n in enumerate([300, 40, 1]) for i in range(n)]
    df = spark.createDataFrame(rows, "output string, day string, seq bigint, bytes bigint")
    for block, header in ((1, 10), (4, 0), (30, 10)):
        levels.clear()
        got = ops.size_rotation_plan(df, 100, header, block).orderBy("output", "seq").collect()
        for k in range(3):
            sizes = [r[3] for r in rows if r[0] == f"o{k}"]
            want = plain_rotation(sizes, 100, header)
            if header == 0:  # an empty file takes a line of any size
                want = [n - want[0] for n in want]
            assert [r.file_no for r in got if r.output == f"o{k}"] == want
        top = levels[-1].groupBy("output", "day").count().collect()
        assert len(levels) > 1 and max(r["count"] for r in top) <= 3
        for level in levels:
            assert all(len(r.prefix) <= 100 // 5 + 2 for r in level.collect())


@pytest.mark.parametrize("block", [1000, 60_000, 3_600_000])
def test_windows_in_rounds(spark, monkeypatch, block):
    """Blocks of any length, entered through rounds of few summaries, give the windows of one pass."""
    monkeypatch.setattr(O, "FAN", 3)
    store, levels = O.stored, []
    monkeypatch.setattr(O, "stored", lambda *a: levels.append(store(*a)) or levels[-1])
    rng, rows, want = random.Random(block), [], {}
    for key, n in (("a", 400), ("b", 30), (None, 5)):
        at, times = -5 * block, []
        for _ in range(n):
            at += rng.choice([1, 300, 999, 1000, 1001, 2500, block // 2, block * 3])
            times.append(at)
        want |= {(key, t): w for t, w in zip(times, map(plain_windows(times, 1000).get, times))}
        rows += [(key, i, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "source string, line_no bigint, ts_ms bigint").repartition(4)
    got = {(r.source, r.ts_ms): r.window_start for r in ops.window_starts(df.na.fill("-"), ["source"], "ts_ms", 1000, block).collect()}
    assert got == {(k or "-", t): w for (k, t), w in want.items()}
    per_task = [lv.selectExpr("source", "block div 3 AS b").groupBy("source", "b").count().agg({"count": "max"}).first()[0] for lv in levels]
    assert len(levels) > 2 and max(per_task) <= 5


def plain_packed(data: bytes) -> int:
    cost, literal = 16, 0
    runs = [len(list(g)) for _, g in groupby(data)]
    for n in runs:
        while n > 1:
            cost += 2 + literal + -(-literal // 128)
            literal, n = 0, n - min(n, 128)
        literal += n
    return cost + literal + -(-literal // 128)


@pytest.mark.parametrize(
    "text", ["", "a", "aa", "abc", "aab" * 50, "x" * 128, "x" * 129 + "y" * 3, "x" * 257, "ab" * 300, "ééé", "a" * 129 + "b" * 129]
)
def test_packed_bytes(ask, text):
    assert ask(T.run_length_packed_bytes, text) == plain_packed(text.encode())


@pytest.mark.parametrize("size", [1, 4, 100])
def test_run_length_round_trip(spark, size):
    rng = random.Random(size)
    rows = [(k, i, rng.choice(["x", "y", None])) for k in ("hot", "b") for i in range(1, 60 if k == "hot" else 9)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v string")
    runs = ops.run_length_rows(df, ["k"], "pos", "v", size)
    got = sorted((r.k, r.first, r.last, r.v or "", r.n) for r in runs.collect())
    want = []
    for k, part in groupby(rows, key=lambda r: r[0]):
        for _, run in groupby(part, key=lambda r: r[2]):
            run = list(run)
            want.append((k, run[0][1], run[-1][1], run[0][2] or "", len(run)))
    assert got == sorted(want)
    back = ops.run_length_expand(runs, "pos").select("k", "pos", "v")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def lines_df(spark, texts, source="a.log"):
    rows = [(source, i, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "source string, line_no bigint, text string")


def test_replay_anchors_on_the_first_late_stamp(spark):
    texts = ["noise", "2026-01-01 10:00:00 [INFO] a", "noise", "2026-01-01 10:00:20 [INFO] b", "raw", "2026-01-01 09:00:00 [INFO] old"]
    df = lines_df(spark, texts).union(lines_df(spark, ["only noise"], "b.log"))
    since = 1767261610000
    kept = ops.replay_since(df, since).orderBy("line_no").collect()
    assert [r.line_no for r in kept] == [4, 5, 6]
    skipped = {r.source: r.skipped_bytes for r in ops.replay_skipped_bytes(df, since).collect()}
    assert skipped == {"a.log": sum(len(t) + 1 for t in texts[:3]), "b.log": 11}


@pytest.mark.parametrize("chunk", [2, 1000])
def test_line_index_and_positioning(spark, chunk):
    texts = [f"2026-01-01 10:00:{i:02d} [INFO] {'x' * (i * 7 % 50)}" if i % 4 else "raw " * 9 for i in range(40)]
    offsets = ops.line_offsets(lines_df(spark, texts), chunk)
    index = {r.mark: r.last_ts_ms for r in ops.build_line_index(offsets, 64).collect()}
    at, stamp, want, starts = 0, 0, {}, []
    base = 1767261600000
    for i, t in enumerate(texts):
        starts.append(at)
        if i % 4:
            stamp = base + i * 1000
        for mark in range((at // 64 + 1) * 64, at + len(t) + 2, 64):
            want[mark] = stamp
        at += len(t) + 1
    assert index == want
    row = ops.replay_positioning(offsets, ops.build_line_index(offsets, 64), base + 20_000).first()
    mark = max(m for m, s in want.items() if s <= base + 20_000)
    assert (row.positioned_by, row.mark, row.start_offset) == ("index", mark, max(s for s in starts if s <= mark))
    early = ops.replay_positioning(offsets, ops.build_line_index(offsets, 64), -1).first()
    assert (early.positioned_by, early.start_offset) == ("fallback", 0)


ROUTES = [
    L.Route("all"),
    L.Route("errors", min_severity=3, format="json"),
    L.Route("disk", predicate=lambda r: L.text_pred(r["message"], "contains", "disk"), chain=L.steps("uppercase")),
    L.Route("shout", predicate=lambda r: r["message"].rlike("^[A-Z ]+$"), chain=L.steps("uppercase"), position="before"),
]


def small_flow(spark, **options):
    texts = [
        "2026-09-06 12:00:00 [INFO] disk ok",
        "2026-09-06 12:00:00 [WARN] connect timeout to db",
        "2026-09-06 12:00:01 [ERROR] disk failed",
        "plain noise",
        "2026-09-06 12:00:02 [DEBUG] x=1 y=2",
    ]
    df = lines_df(spark, texts).withColumns(
        {"ts_ms": F.col("line_no") * 10_000, "ingested_ts": F.lit("2026-09-06").cast("timestamp"), "source_type": F.lit("file")}
    )
    return ops.log_flow(df, options.pop("routes", ROUTES), limit=1, **options)


def test_routes_and_positions(spark):
    flow = small_flow(spark)
    got = {}
    for r in ops.fan_out(flow, ROUTES).collect():
        got.setdefault(r.output, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == {
        "all": [1, 2, 3, 4, 5],
        "errors": [3, 4],
        "disk": [1, 3],
        "shout": [1, 2, 3, 4],
    }
    lines = {(r.output, r.line_no): r.line for r in ops.fan_out(flow, ROUTES).collect()}
    assert "DISK OK |crc=" in lines[("disk", 1)] and "disk ok |crc=" in lines[("all", 1)]


def test_every_line_has_one_fate(spark):
    only = [L.Route("errors", min_severity=3)]
    flow = small_flow(spark, routes=only, threshold=1, keyword="i")
    row = ops.disposition_counters(flow, only).first()
    assert row.ingested == row.rate_dropped + row.filtered + row.unrouted + row.written_records == 5
    assert (row.filtered, row.unrouted, row.written_records, row.written_lines) == (1, 2, 2, 2)


def test_empty_input_gives_zero_counters(spark):
    flow = small_flow(spark).where("false")
    row = ops.disposition_counters(flow, ROUTES).first()
    assert (row.ingested, row.written_lines, row.written_bytes) == (0, 0, 0)
    assert ops.kv_extraction_rate(flow).first().percent == 100
    assert [r.lines for r in ops.level_counts(flow).collect()] == [0] * 5


def test_exposition_text(spark):
    rows = [r.text for r in ops.prometheus_lines(small_flow(spark), ROUTES).collect()]
    assert rows[:2] == ["# HELP opslens_lines_ingested_total Lines read, by level and in all.", "# TYPE opslens_lines_ingested_total counter"]
    assert 'opslens_lines_ingested_total{level="RAW"} 1' in rows and "opslens_lines_ingested_total 5" in rows
    assert 'opslens_field_value_count{key="x",value="1"} 1' in rows
    assert "opslens_kv_extraction_ratio 20" in rows
    assert len([r for r in rows if r.startswith("# TYPE")]) == len({r for r in rows if r.startswith("# TYPE")})


def test_label_escaping(ask):
    assert ask(ops.escape_label, 'a"b\\c\nd') == 'a\\"b\\\\c\\nd'


def test_prune_keeps_the_newest(spark):
    names = [f"m_20260101_0000{i:02d}.prom" for i in range(5)] + ["m.prom", "other.txt"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert sorted(r.name for r in ops.retention_prune(df, 2).collect()) == names[:3]
    assert sorted(r.name for r in ops.retention_prune(df, 0).collect()) == names[:4]


def test_overlay_last_layer_wins(spark):
    rows = [
        ("a", "file", None, 1, "input.file", "f1"),
        ("a", "file", None, 2, "level", "x"),
        ("a", "profile", "prod", 3, "input.files", "p1"),
        ("a", "profile", "test", 4, "input.files", "p2"),
        ("a", "env", None, 5, "level", "y"),
        ("a", "file", None, 6, "level", "z"),
    ]
    df = spark.createDataFrame(rows, "app string, layer string, profile string, seq bigint, key string, value string")
    got = {r.key: (r.value, r.layer, r.renamed) for r in ops.overlay_merge(df, "prod").collect()}
    assert got == {"input.files": ("p1", "profile", False), "level": ("y", "env", False)}


def test_register_levels(spark):
    rows = [(1, "Audit", 7), (2, "AUDIT", 8), (3, "audit", 7), (4, " ", 5), (5, "Warn", 9), (6, "big", 1000), (7, "low", 0)]
    got = {r.seq: r.error for r in ops.register_levels(spark.createDataFrame(rows, "seq bigint, name string, value bigint")).collect()}
    assert got == {
        1: None, 2: "already registered", 3: None, 4: "empty name", 5: "built-in name",
        6: "value out of range", 7: "value out of range",
    }


def test_rotation_plan_makes_no_frame_per_block(spark):
    df = spark.createDataFrame([("o", "d", i, 7) for i in range(60)], "output string, day string, seq bigint, bytes bigint")
    plan = ops.size_rotation_plan(df, 100, 10, 2)
    assert "GroupsIn" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [r.file_no for r in plan.orderBy("seq").collect()] == plain_rotation([7] * 60, 100, 10)
