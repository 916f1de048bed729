"""Readers, sinks and streams on files."""

import pytest
from pyspark.sql import functions as F

from opslens.functions import logline as L
from opslens.functions import text as T
from opslens.operators import logs as ops
from opslens.operators import results as R
from opslens.sources import readers, sinks
from opslens.streaming import flows


def test_read_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\rstill two\n\nfour")
    (tmp_path / "b.log").write_bytes("ü\n".encode())
    (tmp_path / "b-old.log").write_bytes(b"x\n")
    df = readers.read_log_lines(spark, str(tmp_path), include="*.log", excludes=["*-old*"])
    got = sorted((r.source.rsplit("/", 1)[1], r.line_no, r.text) for r in df.collect())
    assert got == [("a.log", 1, "one"), ("a.log", 2, "two\rstill two"), ("a.log", 3, ""), ("a.log", 4, "four"), ("b.log", 1, "ü")]


def test_line_numbers_run_on_over_splits(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 40) for i in range(1, 3001)]
    (tmp_path / "big.log").write_text("\n".join(texts) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = readers.read_log_lines(spark, str(tmp_path / "big.log"))
        assert spark.read.text(str(tmp_path / "big.log")).rdd.getNumPartitions() > 1
        assert [r.text for r in df.orderBy("line_no").collect()] == texts
        assert {r.n for r in df.groupBy("line_no").agg(F.count(F.lit(1)).alias("n")).collect()} == {1}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_read_task_results(spark, tmp_path):
    (tmp_path / "r_20260102.log").write_text("2026-01-02 00:00:00 task_id=1 status=OK\r\n")
    lines, found = readers.read_task_results(spark, str(tmp_path), "r", "2026-01-02")
    assert found and R.parse_task_result(lines).first().status == "OK"
    none, found = readers.read_task_results(spark, str(tmp_path), "r", "20260103")
    assert not found and none.count() == 0


def test_distinct_paths(spark):
    names = ["logs/a", "./logs/a", "logs//a", "logs/x/../a", "/logs/a", "../a", "b/../../a"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert sorted(r.path for r in readers.distinct_paths(df).collect()) == ["../a", "/logs/a", "logs/a"]


def test_sinks(spark, tmp_path):
    rows = [("logs/a.log", "2026-01-01 00:00:00", "x"), ("logs/b c.log", "2026-01-02 00:00:00", "y")]
    df = spark.createDataFrame(rows, "source string, at string, line string").withColumn("at", F.col("at").cast("timestamp"))
    sinks.write_daily(df, F.col("line"), F.col("at"), str(tmp_path / "d"))
    sinks.write_per_source(df, F.col("line"), str(tmp_path / "s"))
    sinks.write_outputs(df.withColumn("output", F.lit("all")), str(tmp_path / "o"))
    sinks.write_task_results(df, F.col("line"), F.col("at"), str(tmp_path / "t"))
    folders = {p.name for kind in "dsot" for p in (tmp_path / kind).iterdir() if p.is_dir()}
    assert folders == {"dt=2026-01-01", "dt=2026-01-02", "name=a_log", "name=b_c_log", "output=all", "day=20260101", "day=20260102"}
    assert spark.read.text(str(tmp_path / "s/name=b_c_log")).first().value == "y"


def log_batches(spark, folder, count=4, per=50):
    """Parquet files whose time ranges follow each other, cutting through seconds."""
    rows = [("hot" if i % 3 else "cold", i, i * 130, f"2026-01-01 00:00:{i // 8 % 60:02d} [INFO] k=v{i % 5}") for i in range(count * per)]
    ddl = "source string, line_no bigint, ts_ms bigint, text string"
    whole = spark.createDataFrame(rows, ddl).withColumn("ingested_ts", F.timestamp_millis("ts_ms")).withColumn("source_type", F.lit("file"))
    for b in range(count):
        part = whole.where((F.col("line_no") >= b * per) & (F.col("line_no") < (b + 1) * per))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return whole


def stream_of(spark, folder, whole):
    return flows.stream_table(spark, str(folder), whole.schema, per_batch=1)


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    whole = log_batches(spark, tmp_path / "in")
    out = str(tmp_path / "limit")
    flows.stream_rate_limit(stream_of(spark, tmp_path / "in", whole), out, 3)
    got = flows.read_limited(spark, out)
    assert got.select("epoch").distinct().count() == 4
    want = ops.rate_limit_anchored(whole, 3)
    columns = ["source", "line_no", "window_start", "admitted"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))

    routes = [L.Route("all"), L.Route("v1", predicate=lambda r: L.kv_pred(r["fields"], "k", "=", "V1"))]
    out = str(tmp_path / "flow")
    flows.stream_log_flow(stream_of(spark, tmp_path / "in", whole), out, routes, limit=2)
    want = ops.fan_out(ops.log_flow(whole, routes, limit=2), routes)
    columns = ["source", "line_no", "output", "line"]
    assert sorted(map(tuple, flows.read_batches(spark, out).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_stream_resumes_after_restart(spark, tmp_path):
    whole = log_batches(spark, tmp_path / "in", count=2)
    out = str(tmp_path / "kv")
    flows.stream_kv_counts(stream_of(spark, tmp_path / "in", whole), out)
    assert flows.kv_top_n(spark, out, 1).first().cnt == 20
    whole.where("line_no < 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flows.stream_kv_counts(stream_of(spark, tmp_path / "in", whole), out)
    rows = flows.kv_top_n(spark, out, 9).collect()
    assert sum(r.cnt for r in rows) == 110 and len(rows) == 5


def test_counters_and_windows(spark, tmp_path):
    whole = log_batches(spark, tmp_path / "in")
    flows.stream_counters(stream_of(spark, tmp_path / "in", whole), str(tmp_path / "c"))
    assert [(r.level, r.lines) for r in flows.last_snapshot(spark, str(tmp_path / "c")).collect()] == [("INFO", 200)]
    flows.stream_window_counts(stream_of(spark, tmp_path / "in", whole), str(tmp_path / "w"), "ingested_ts", "10 seconds", "1 hour")
    counts = flows.latest(flows.read_batches(spark, str(tmp_path / "w")), ["window_start", "level"]).collect()
    assert sum(r.lines for r in counts) == 200 and len(counts) == 3


def test_stream_log_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_bytes(b"2026-01-01 00:00:00 [INFO] a\r\nraw\n")
    out = str(tmp_path / "out")
    flows.land_log_files(flows.stream_log_lines(spark, str(tmp_path / "in")), out)
    (tmp_path / "in/b.log").write_bytes(b"late\n")
    flows.land_log_files(flows.stream_log_lines(spark, str(tmp_path / "in")), out)
    rows = flows.read_batches(spark, out).orderBy("source", "line_no").collect()
    assert [(r.source[-5:], r.line_no, r.text) for r in rows] == [
        ("a.log", 1, "2026-01-01 00:00:00 [INFO] a"), ("a.log", 2, "raw"), ("b.log", 1, "late")
    ]


def test_result_stream(spark, tmp_path):
    lines = [f"2026-01-01 00:00:00 task_id={i} status={'OK' if i % 2 else 'FAILED'} tag=t{i % 3}" for i in range(30)]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    for b in range(3):
        df.where(F.regexp_extract("text", r"task_id=(\d+)", 1).cast("int") % 3 == b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    flows.stream_result_stats(flows.stream_table(spark, str(tmp_path / "in"), df.schema, per_batch=1), out)
    got = sorted(map(tuple, flows.latest(flows.read_batches(spark, out), ["tag"]).collect()))
    assert got == sorted(map(tuple, R.tag_status_stats(R.parse_task_result(df)).collect()))


def test_snapshots_at_an_interval(spark, tmp_path):
    whole = log_batches(spark, tmp_path / "in", count=2)
    query = flows.stream_counters(stream_of(spark, tmp_path / "in", whole), str(tmp_path / "c"), interval="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    snapshots = flows.read_batches(spark, str(tmp_path / "c")).orderBy("epoch").collect()
    assert [r.lines for r in snapshots][-1] == 100
    assert [r.lines for r in flows.last_snapshot(spark, str(tmp_path / "c")).collect()] == [100]
