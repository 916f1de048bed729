"""Streams over several batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from opslens.functions import logline as L
from opslens.operators import logs as ops
from opslens.streaming import flows

ROUTES = [L.Route("all", 0)] if hasattr(L, "Route") else []


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small streams: every partition of every batch opens a state store."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def land(spark, folder, number, rows):
    df = spark.createDataFrame(rows, "source string, line_no bigint, ts_ms bigint, ingested_ts timestamp, text string")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/b={number}")


def lines(at):
    import datetime

    now = datetime.datetime(2026, 1, 1)
    return [("a", n, ms, now, f"k={n % 2} line") for n, ms in at]


def test_a_second_that_returns_keeps_its_count(spark, tmp_path):
    """An older second comes back in a later batch: the limit still holds."""
    batches = [lines([(1, 1000), (2, 2000), (3, 2100)]), lines([(4, 1100), (5, 1200), (6, 2200)])]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number, rows in enumerate(batches):
        land(spark, folder, number, rows)
    schema = spark.read.parquet(folder).drop("b").schema
    stream = flows.stream_table(spark, f"{folder}/b=*", schema, per_batch=1)
    flows.stream_log_flow(stream, out, ROUTES, limit=2)
    got = sorted((r.source, r.line_no) for r in flows.read_batches(spark, out).collect())
    assert len(got) == 4
    counters = {(r.family, r.label): r.n for r in flows.flow_counters(spark, out).collect()}
    assert counters[("disposition", "rate_dropped")] == 2 and counters[("source", "a")] == 4
    assert counters[("output_lines", "all")] == 4


def test_missing_state_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|Path does not exist"):
        flows._previous(spark, str(tmp_path / "gone"), 3, "a int").collect()
    assert flows._previous(spark, str(tmp_path / "gone"), 0, "a int").count() == 0


def test_field_counts_over_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number in range(3):
        land(spark, folder, number, lines([(n + 10 * number, 1000 * n) for n in range(5)]))
    schema = spark.read.parquet(folder).drop("b").schema
    flows.stream_kv_counts(flows.stream_table(spark, f"{folder}/b=*", schema, per_batch=1), out)
    got = {(r["key"], r["value"]): r["cnt"] for r in flows.kv_top_n(spark, out).collect()}
    want = {}
    for row in spark.read.parquet(folder).collect():
        want[("k", str(row.line_no % 2))] = want.get(("k", str(row.line_no % 2)), 0) + 1
    assert got == want


@pytest.mark.parametrize("batches", [1, 2, 3, 4, 5, 8, 9, 13, 27, 28])
def test_merge_levels_cover_every_batch_once(batches):
    held = [b for level, n in flows.merge_levels(batches, 3) for b in range(n * 3**level, (n + 1) * 3**level)]
    assert held == list(range(batches))
    assert len(flows.merge_levels(batches, 3)) <= 2 * 4


def test_field_counts_in_levels(spark, tmp_path):
    """Merged folders go, a batch that dies between its merges loses nothing when it is run again."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = None
    for number in range(10):
        land(spark, folder, number, lines([(n + 10 * number, 1000 * n) for n in range(4)]))
    schema = spark.read.parquet(folder).drop("b").schema
    stream = flows.stream_table(spark, f"{folder}/b=*", schema, per_batch=1)

    write, calls = flows.remove_dir, []

    def dies(session, path):
        calls.append(path)
        if len(calls) == 4:
            raise OSError("lost")
        write(session, path)

    flows.remove_dir = dies
    try:
        with pytest.raises(Exception, match="lost"):
            flows.stream_kv_counts(stream, out, fan=3)
    finally:
        flows.remove_dir = write
    flows.stream_kv_counts(flows.stream_table(spark, f"{folder}/b=*", schema, per_batch=1), out, fan=3)
    got = {(r["key"], r["value"]): r["cnt"] for r in flows.kv_counts(spark, out, fan=3).collect()}
    assert got == {("k", "0"): 20, ("k", "1"): 20}
    left = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").glob("level=*/*"))
    assert left == ["level=0/part=000000000009", "level=2/part=000000000000"]


def limited(rows):
    return {(r.source, r.line_no): (r.window_start, r.admitted) for r in rows}


def stamped(spark, folder, number, rows):
    df = spark.createDataFrame(rows, "source string, line_no bigint, ts_ms bigint")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/b={number}")


def rate_stream(spark, folder):
    return flows.stream_table(spark, f"{folder}/b=*", "source string, line_no bigint, ts_ms bigint", per_batch=1)


@pytest.mark.parametrize("limit", [0, 2])
def test_anchored_limit_goes_on_after_a_restart(spark, tmp_path, limit):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(s, n, 170 * n - 900 + (37 if s == "b" else 0)) for n in range(40) for s in ("a", "b")]
    for number in range(4):
        stamped(spark, folder, number, rows[number * 15 : number * 15 + 15])
    flows.stream_rate_limit(rate_stream(spark, folder), out, limit)
    for number in range(4, 6):
        stamped(spark, folder, number, rows[number * 15 : number * 15 + 15])
    flows.stream_rate_limit(rate_stream(spark, folder), out, limit)
    want = ops.rate_limit_anchored(spark.createDataFrame(rows, "source string, line_no bigint, ts_ms bigint"), limit)
    assert limited(flows.read_limited(spark, out).collect()) == limited(want.collect())


def test_lines_out_of_order_are_held(spark, tmp_path):
    """Within the delay the order of arrival does not matter; a timer settles what the watermark has passed."""
    import random

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(s, n, 1_000_000 + 130 * n + (k * 50)) for n in range(60) for k, s in enumerate("abc")]
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    for number in range(4):
        stamped(spark, folder, number, mixed[number * 45 : number * 45 + 45])
    stamped(spark, folder, 4, [("z", 0, 9_000_000)])
    stamped(spark, folder, 5, [("z", 1, 9_000_001)])
    flows.stream_rate_limit(rate_stream(spark, folder), out, 3, delay="60 seconds", hold=True)
    got = {k: v for k, v in limited(flows.read_limited(spark, out, hold=True).collect()).items() if k[0] != "z"}
    want = ops.rate_limit_anchored(spark.createDataFrame(rows, "source string, line_no bigint, ts_ms bigint"), 3)
    assert got == limited(want.collect())
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{out}-checkpoint")
    assert [r["key"]["source"] for r in state.collect()] == ["z"]  # silent sources have left it


def test_seconds_behind_the_watermark_leave_the_state(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, folder, 0, lines([(1, 1000), (2, 1100), (3, 2000)]))
    land(spark, folder, 1, lines([(4, 1200), (5, 90_000)]))
    land(spark, folder, 2, lines([(6, 90_100)]))
    land(spark, folder, 3, lines([(7, 1300), (8, 1400), (9, 1500)]))  # too late: the second opens anew
    schema = spark.read.parquet(folder).drop("b").schema
    flows.stream_log_flow(flows.stream_table(spark, f"{folder}/b=*", schema, per_batch=1), out, ROUTES, limit=2, late_seconds=10)
    got = sorted(r.line_no for r in flows.read_batches(spark, out).collect())
    assert got == [1, 2, 3, 5, 6, 7, 8]
    state = spark.read.format("statestore").option("stateVarName", "seconds").load(f"{out}-checkpoint").collect()
    assert [list(r["value"]["second"]) for r in state] == [[90]]
    assert len(list((tmp_path / "out-landed").glob("epoch=*"))) <= 2


def test_offsets_count_carriage_returns(spark, tmp_path):
    from opslens.sources import readers

    path = tmp_path / "a.log"
    path.write_bytes(b"one\r\ntwo\nthree\r\n" * 5)
    read = readers.read_log_lines(spark, str(path))
    offsets = ops.line_offsets(read).orderBy("line_no").collect()
    assert offsets[-1].end == path.stat().st_size
    assert [r.start for r in offsets[:4]] == [0, 5, 9, 16]


def test_one_window_for_all_sources(spark):
    rows = [("a", 1, 0), ("b", 1, 10), ("a", 2, 20), ("b", 2, 1500), ("a", 3, 1600)]
    df = spark.createDataFrame(rows, "source string, line_no bigint, ts_ms bigint")
    got = {(r.source, r.line_no): r.admitted for r in ops.rate_limit_anchored(df, 1, keys=()).collect()}
    assert got == {("a", 1): True, ("b", 1): False, ("a", 2): False, ("b", 2): True, ("a", 3): False}


@pytest.mark.parametrize(
    "text", ["", "a", "a\n", "a\r\nb", "a\x0cb\rc d", "a b\x85c\x1dd\n\n", "\n", "\r", "x\r\r\ny"]
)
def test_lines_end_as_in_splitlines(ask, text):
    from opslens.functions import code as C

    assert ask(C.split_lines, text) == text.splitlines()


def test_ids_of_twenty_digits(spark):
    from opslens.operators import results

    big = 2**64 - 1
    df = spark.createDataFrame(
        [(f"2026-01-01 00:00:00.000 [trace] enqueue task={n} a=1",) for n in (7, 10**18, big, big + 1)], "text string"
    )
    assert sorted(int(r.task_id) for r in results.parse_trace_line(df).collect()) == [7, 10**18, big]


def test_repeated_keys_keep_the_last_value(ask):
    assert ask(L.kv_strict, "a=1 b=2 a=3 c=4 b=5") == {"a": "3", "b": "5", "c": "4"}


class Kept:
    """A processor's handle and state in plain Python."""

    value = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_busy_source_is_judged_in_arrays(monkeypatch):
    """Memory per line of one source stays that of some numbers; decisions leave in parts."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from opslens.streaming import limits

    count = 200_000
    frames = [pd.DataFrame({"ts_ms": 700 * np.arange(a, a + 10_000), "line_no": np.arange(a, a + 10_000)}) for a in range(0, count, 10_000)]
    for processor in (limits.AnchoredLimit(2, 1000, False), limits.SecondLimit(2)):
        processor.init(Kept())
        tracemalloc.start()
        sizes = [len(f) for f in processor.handleInputRows(("a",), iter(frames), Kept())]
        peak = tracemalloc.get_traced_memory()[1] / count
        tracemalloc.stop()
        assert sum(sizes) >= count // 2 and max(sizes) <= 1 << 16, sizes
        assert peak < 150, peak


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_anchored_windows_in_parts(monkeypatch, limit):
    """Judged in parts and over batches, as line by line."""
    import numpy as np
    import pandas as pd

    from opslens.streaming import limits

    monkeypatch.setattr(limits, "OUT_ROWS", 7)
    rng = np.random.default_rng(limit)
    processor = limits.AnchoredLimit(limit, 1000, False)
    processor.init(Kept())
    start, used = None, 0
    for _ in range(4):
        times, numbers = rng.integers(0, 9000, 80) // 50 * 50, rng.permutation(80)
        got = pd.concat(processor.handleInputRows(("a",), iter([pd.DataFrame({"ts_ms": times, "line_no": numbers})]), Kept()))
        want = []
        for at in np.unique(times).tolist():
            own = np.sort(numbers[times == at])
            if start is None or at >= start + 1000:
                start, used = at, 0
            take = min(limit - used, len(own)) if limit else 0
            used += take
            want.append((at, start, limits.EVERY if not limit else int(own[take - 1]) if take else None))
        assert [(a, w, None if pd.isna(x) else int(x)) for a, w, x in zip(got.ts_ms, got.window_start, got.last_line)] == want
