"""Task result lines, statistics and traces."""

import json

import pytest
from pyspark.sql import functions as F

from opslens.operators import results as R

HEAD = "2026-09-06 12:00:00 task_id=7 "


@pytest.mark.parametrize(
    "rest,want",
    [
        ("status=OK tag=a type=oneshot worker=3 duration_us=1500 detail=x", ("OK", "a", 3, 1500, "parsed")),
        ("status=OK duration_ms=12.345 detail=old line", ("OK", "-", None, 12345, "parsed")),
        ("status=FAILED duration_ms=12 duration_us=9 tag=b", ("FAILED", "b", None, 9, "parsed")),
        ("status=OK duration_us=- duration_ms=1.5", ("OK", "-", None, 1500, "parsed")),
        ("status=OK detail=tag=inner worker=5", ("OK", "-", None, None, "parsed")),
        ("status=OK status=FAILED tag=a tag=b worker=x worker=2", ("OK", "a", 2, None, "parsed")),
        ("status=OK worker=1234567890 worker=9 duration_ms=1.2345", ("OK", "-", 9, None, "parsed")),
        ("status=BOGUS tag=a", ("BOGUS", "a", None, None, "skipped")),
        ("tag=a", (None, "a", None, None, "skipped")),
        ("xdetail=1 status=OK", ("OK", "-", None, None, "parsed")),
    ],
)
def test_result_line(spark, rest, want):
    row = R.parse_task_result(spark.createDataFrame([(HEAD + rest,)], "text string")).first()
    assert (row.status, row.tag, row.worker, row.duration_us, row["class"]) == want
    assert row.task_id == 7


def results(spark, rows):
    lines = [f"{HEAD}status={s} tag={t} worker={w} duration_us={d} detail=attempt {i % 3 + 1} of 3: x" for i, (s, t, w, d) in enumerate(rows)]
    lines += ["", "garbage", HEAD + "status=ODD"]
    return R.parse_task_result(spark.createDataFrame([(x,) for x in lines], "text string"))


ROWS = [("OK", "a", 1, 1000), ("FAILED", "a", 2, 3000), ("OK", "b,\"q\"", "-", "-"), ("CANCELLED", "a", "-", "-"), ("RETRYING", "a", 1, 2000)]


def test_blocks_and_totals(spark):
    df = results(spark, ROWS)
    counts = R.classify_result_lines(df).first()
    assert (counts.lines_total, counts.lines_parsed, counts.lines_skipped, counts.lines_blank) == (7, 5, 2, 1)
    got = {(r.block, r.name): (r.ok, r.failed, r.retrying, r.cancelled, r.total) for r in R.tag_stats_total(df).collect()}
    assert got[("tag", "TOTAL")] == (2, 1, 1, 1, 5)
    assert got[("worker", "TOTAL")] == (1, 1, 1, 0, 3)
    assert got[("tag", "a")] == (1, 1, 1, 1, 4)
    assert got[("worker", "1")] == (1, 0, 1, 0, 2)
    assert got[("tag", "TOTAL")][4] == counts.lines_parsed


def test_p95_skips_tags_without_durations(spark):
    assert {r.tag: r.p95_us for r in R.tag_p95(results(spark, ROWS)).collect()} == {"a": 3000}


def test_csv_report(spark):
    lines = [r.text for r in R.export_tag_stats_csv(results(spark, ROWS), "r.log").orderBy("section", "place").collect()]
    assert lines == [
        "log_file,r.log", "file_found,true", "lines_total,7", "lines_parsed,5", "lines_skipped,2",
        "tag,ok,failed,retrying,cancelled,total,p95_duration_ms",
        "a,1,1,1,1,4,3.000",
        '"b,""q""",1,0,0,0,1,',
        "TOTAL,2,1,1,1,5,",
        "worker,ok,failed,retrying,cancelled,total",
        "1,1,0,1,0,2", "2,0,1,0,0,1", "TOTAL,1,1,1,0,3",
    ]


def test_json_report_is_one_document(spark):
    rows = R.export_tag_stats_json(results(spark, ROWS), 'r"1.log').orderBy("section", "place").collect()
    report = json.loads("\n".join(r.text for r in rows))
    assert report["log_file"] == 'r"1.log' and report["lines_parsed"] == 5
    assert report["tags"][0] == {"tag": "a", "ok": 1, "failed": 1, "retrying": 1, "cancelled": 1, "total": 4, "p95_duration_ms": 3.0}
    assert report["tags"][1]["p95_duration_ms"] is None
    assert [w["worker"] for w in report["workers"]] == [1, 2]
    empty = R.export_tag_stats_json(results(spark, []), "r.log", False).orderBy("section", "place").collect()
    assert json.loads("\n".join(r.text for r in empty))["tags"] == []


def test_task_metrics(spark):
    row = R.task_metrics(results(spark, ROWS), F.lit(2)).first()
    assert (row.executed, row.failed, row.retried, row.cancelled) == (2, 1, 1, 1)
    assert row.average_ms == pytest.approx((1000 + 3000 + 0 + 2000) / 4 / 1000)
    assert (row.ok_low, row.ok_high, row.ok_critical) == (0, 2, 0)
    assert R.task_metrics(results(spark, []), F.lit(0)).first().average_ms == 0


def test_attempts_and_dead_letters(spark):
    lines = [f"{HEAD}status={s} detail=attempt {i + 1} of 3: e" for i, s in enumerate(["RETRYING", "RETRYING", "FAILED"])]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq bigint, text string")
    parsed = R.parse_task_result(df)
    row = R.attempts_per_task(parsed).first()
    assert (row.task_id, row.attempts, row.retries, row.last_status, row.last_attempt, row.allowed) == (7, 3, 2, "FAILED", 3, 3)
    assert [(r.seq, r.detail) for r in R.dead_letters(parsed).collect()] == [(2, "attempt 3 of 3: e")]


@pytest.mark.parametrize("ms,us", [(1.0004, 1000), (1.0005, 1001), (0.0, 0), (-0.5, -1)])
def test_ms_to_us(ask, ms, us):
    assert ask(R.ms_to_us, ms) == us


def test_canonical_line_parses_back(spark):
    row = {
        "ts": F.lit("2026-01-02 03:04:05").cast("timestamp"), "task_id": F.lit(9), "status": F.lit("OK"), "tag": F.lit(""),
        "type": F.lit(None).cast("string"), "worker": F.lit(-1), "duration_us": F.lit(-1), "detail": F.lit(""),
    }
    text = spark.range(1).select(R.task_result_text(row).alias("text"))
    assert text.first().text == "2026-01-02 03:04:05 task_id=9 status=OK tag=- type=- worker=- duration_us=- detail=-"
    assert R.parse_task_result(text).first()["class"] == "parsed"


def trace_df(spark, rows):
    return spark.createDataFrame(rows, "task_id bigint, seq bigint, at_ms bigint, event string")


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_latency_per_attempt(spark, chunk):
    rows = [(1, i, at, e) for i, (e, at) in enumerate(
        [("enqueue", 0), ("dequeue", 5), ("start", 6), ("finish", 10), ("retry_requeue", 20), ("dequeue", 27), ("start", 30), ("finish", 31)])]
    got = {r.attempt: (r.queue_wait_ms, r.run_ms, r.retry_gap_ms) for r in R.task_latency(trace_df(spark, rows), chunk).collect()}
    assert got == {1: (5, 4, None), 2: (7, 1, 7)}


def test_cancel_succeeds_once_per_stay(spark):
    trace = trace_df(spark, [
        (1, 0, 0, "enqueue"), (1, 1, 50, "dequeue"), (2, 0, 0, "enqueue"), (3, 0, 10, "enqueue"), (3, 1, 20, "cancel"), (4, 0, 0, "enqueue"),
    ])
    requests = spark.createDataFrame([(1, 1, 10), (1, 2, 60), (2, 1, 5), (2, 2, 6), (3, 1, 5), (3, 2, 30), (9, 1, 1)], "task_id bigint, request_id int, at_ms bigint")
    resolved = R.cancel_resolution(trace, requests, bucket=7)
    got = {(r.task_id, r.request_id): r.cancelled for r in resolved.collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): True, (2, 2): False, (3, 1): False, (3, 2): False, (9, 1): False}
    assert [r.task_id for r in R.surviving_queue(trace, resolved).collect()] == [4]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_dispatch_order(spark, chunk):
    rows = [("t", s, p) for s, p in enumerate([0, 3, 1, 3, 0, 2])]
    df = spark.createDataFrame(rows, "tenant string, seq bigint, priority int")
    got = R.dispatch_order(df, ["tenant"], chunk).orderBy("position").collect()
    assert [r.seq for r in got] == [1, 3, 5, 2, 0, 4] and [r.position for r in got] == [1, 2, 3, 4, 5, 6]


def test_trace_lines(spark):
    texts = [
        "2026-01-01 00:00:00.250 [trace] finish task=12 status=OK note=\"a b\"",
        "2026-01-01 00:00:00.250 [trace] dance task=12",
        "2026-01-01 00:00:00.250 [debug] start task=12",
        "2026-01-01 00:00:00.250 [trace] start task=x",
    ]
    rows = R.parse_trace_line(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [(r.at_ms, r.event, r.task_id, r.fields) for r in rows] == [
        (1767225600250, "finish", 12, {"task": "12", "status": "OK", "note": "a b"})
    ]
