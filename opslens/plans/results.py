"""Registered queries of the task result and trace family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.operators import results as ops
from opslens.plans.oracle import sql
from opslens.session import fresh_dir
from opslens.sources import readers, sinks, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = sql(oracle)
        return build

    return register


def parsed(spark, sf):
    return _with_long_id(ops.parse_task_result(views.task_result_lines(spark, sf)))


def _with_long_id(rows):
    """The tables' ids are longs; the parsers read any unsigned 64-bit id."""
    return rows.withColumn("task_id", F.col("task_id").cast("bigint"))


def trace(spark, sf):
    return _with_long_id(ops.parse_trace_line(views.trace_lines(spark, sf)))


_COUNTS = """count(*) FILTER (WHERE status = 'OK') AS ok, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status = 'RETRYING') AS retrying, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled,
  count(*) AS total"""


@query("parse_task_result", "SELECT line_id, task_id, status, tag, worker, duration_us FROM task_rows")
def _(spark, sf):
    return (
        parsed(spark, sf)
        .where(F.col("status").isNotNull())
        .select("line_id", "task_id", "status", "tag", F.col("worker").cast("bigint").alias("worker"), "duration_us")
    )


@query(
    "duration_normalize",
    """SELECT line_id, duration_us FROM task_rows WHERE duration_us IS NOT NULL""",
)
def _(spark, sf):
    text = F.col("text")
    us = F.nullif(F.regexp_extract(text, r"duration_us=(\d+) ", 1), F.lit("")).cast("bigint")
    ms = ops.ms_text_to_us(F.regexp_extract(text, r"duration_ms=([\d.]+) ", 1))
    return (
        views.task_result_lines(spark, sf)
        .select("line_id", F.coalesce(us, ms).alias("duration_us"))
        .where(F.col("duration_us").isNotNull())
    )


@query(
    "classify_result_lines",
    """SELECT (SELECT count(*) FROM orders) AS lines_total, (SELECT count(*) FROM task_good) AS lines_parsed,
      (SELECT count(*) FROM orders) - (SELECT count(*) FROM task_good) AS lines_skipped, 0 AS lines_blank""",
)
def _(spark, sf):
    return ops.classify_result_lines(parsed(spark, sf))


@query(
    "read_task_results",
    """SELECT strftime(date_trunc('month', ts), '%Y%m%d') AS day, count(*) AS lines FROM task_good
      WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' GROUP BY 1""",
)
def _(spark, sf):
    out = fresh_dir(spark, "read_task_results")
    rows = ops.accepted(parsed(spark, sf))
    # One file per month here: the table spans years and would give thousands of days.
    sinks.write_task_results(rows, F.col("text"), F.date_trunc("month", "ts"), out)
    read = readers.read_result_days(spark, out, "19970101", "19971231")
    return ops.accepted(ops.parse_task_result(read)).groupBy("day").agg(F.count(F.lit(1)).alias("lines"))


@query("parse_trace_line", "SELECT task_id, seq, event, at_ms, CAST(task_id AS VARCHAR) AS task, status FROM trace_rows")
def _(spark, sf):
    return trace(spark, sf).select(
        "task_id", "seq", "event", "at_ms",
        F.try_element_at("fields", F.lit("task")).alias("task"),
        F.try_element_at("fields", F.lit("status")).alias("status"),
    )


@query("tag_status_stats", f"SELECT tag, {_COUNTS} FROM task_good GROUP BY tag")
def _(spark, sf):
    return ops.tag_status_stats(parsed(spark, sf))


@query("worker_status_stats", f"SELECT worker, {_COUNTS} FROM task_good WHERE worker IS NOT NULL GROUP BY worker")
def _(spark, sf):
    return ops.worker_status_stats(parsed(spark, sf)).withColumn("worker", F.col("worker").cast("bigint"))


_BLOCKS = f"""SELECT 'tag' AS block, tag AS name, {_COUNTS} FROM task_good GROUP BY tag
  UNION ALL SELECT 'tag', 'TOTAL', {_COUNTS} FROM task_good
  UNION ALL SELECT 'worker', CAST(worker AS VARCHAR), {_COUNTS} FROM task_good WHERE worker IS NOT NULL GROUP BY worker
  UNION ALL SELECT 'worker', 'TOTAL', {_COUNTS} FROM task_good WHERE worker IS NOT NULL"""


@query("tag_stats_total", _BLOCKS)
def _(spark, sf):
    return ops.tag_stats_total(parsed(spark, sf))


_P95 = """SELECT tag, duration_us AS p95_us FROM (SELECT tag, duration_us,
    row_number() OVER (PARTITION BY tag ORDER BY duration_us) AS rn, count(*) OVER (PARTITION BY tag) AS n
  FROM task_good WHERE duration_us IS NOT NULL) x WHERE rn = (n * 95 + 99) // 100"""


@query("tag_p95", _P95)
def _(spark, sf):
    return ops.tag_p95(parsed(spark, sf))


@query(
    "task_metrics",
    """SELECT count(*) FILTER (WHERE status = 'OK') AS executed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
      count(*) FILTER (WHERE status = 'RETRYING') AS retried, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled,
      round(sum(duration_us) FILTER (WHERE status <> 'CANCELLED') / 1000.0 / count(*) FILTER (WHERE status <> 'CANCELLED'), 3) AS average_ms,
      count(*) FILTER (WHERE status = 'OK' AND line_id % 3 = 0) AS ok_low, count(*) FILTER (WHERE status = 'OK' AND line_id % 3 = 1) AS ok_normal,
      count(*) FILTER (WHERE status = 'OK' AND line_id % 3 = 2) AS ok_high, 0 AS ok_critical FROM task_good""",
)
def _(spark, sf):
    metrics = ops.task_metrics(parsed(spark, sf), F.col("line_id") % 3)
    return metrics.withColumn("average_ms", F.round("average_ms", 3))


def _chained(spark, sf):
    """Every three consecutive result lines as the attempts of one task."""
    return parsed(spark, sf).withColumns({"seq": F.col("line_id"), "task_id": F.expr("line_id div 3")})


@query(
    "attempts_per_task",
    """SELECT line_id // 3 AS task_id, count(*) AS attempts, count(*) FILTER (WHERE status = 'RETRYING') AS retries,
      arg_max(status, line_id) AS last_status, max(attempt) AS last_attempt, 3 AS allowed FROM task_good GROUP BY 1""",
)
def _(spark, sf):
    return ops.attempts_per_task(_chained(spark, sf))


@query(
    "dead_letters",
    """SELECT line_id AS seq, line_id // 3 AS task_id, 'attempt ' || attempt || ' of 3: tag=not_this_one' AS detail
      FROM task_good WHERE status = 'FAILED'""",
)
def _(spark, sf):
    return ops.dead_letters(_chained(spark, sf))


@query(
    "dispatch_order",
    """SELECT tenant, seq, row_number() OVER (PARTITION BY tenant ORDER BY priority DESC, seq) AS position FROM (
      SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 5 END AS tenant, o_orderkey AS seq, o_custkey % 4 AS priority FROM orders) x""",
)
def _(spark, sf):
    queue = views.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 5).alias("tenant"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") % 4).alias("priority"),
    )
    return ops.dispatch_order(queue, ["tenant"], 1 << 16).select("tenant", "seq", "position")


@query(
    "task_latency",
    """SELECT task_id, attempt,
      min(at_ms) FILTER (WHERE event = 'dequeue') - min(at_ms) FILTER (WHERE event IN ('enqueue', 'retry_requeue')) AS queue_wait_ms,
      min(at_ms) FILTER (WHERE event = 'finish') - min(at_ms) FILTER (WHERE event = 'start') AS run_ms,
      min(at_ms) FILTER (WHERE event = 'dequeue') - min(at_ms) FILTER (WHERE event = 'retry_requeue') AS retry_gap_ms
    FROM trace_rows GROUP BY task_id, attempt""",
)
def _(spark, sf):
    return ops.task_latency(trace(spark, sf))


def _cancels(spark, sf):
    """Two requests for every task: a little after it entered the queue for every seventh, before that for the others."""
    orders = views.table(spark, sf, "orders")
    at = F.lit(1_700_000_000_000) + F.col("o_orderkey") * 10
    side = F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(-1)
    return orders.select(
        F.col("o_orderkey").alias("task_id"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("request_id"), (at + side * 60).alias("at_ms")),
                F.struct(F.lit(2).alias("request_id"), (at + side * 150).alias("at_ms")),
            )
        ),
    )


_CANCEL = """SELECT r.task_id, r.request_id, r.at_ms, s.event AS state, s.at_ms AS since FROM (
    SELECT o_orderkey AS task_id, q.request_id, 1700000000000 + o_orderkey * 10 + CASE WHEN o_orderkey % 7 = 0 THEN q.d ELSE -q.d END AS at_ms
    FROM orders, (VALUES (1, 60), (2, 150)) q(request_id, d)) r
  LEFT JOIN LATERAL (SELECT t.event, t.at_ms FROM trace_rows t WHERE t.task_id = r.task_id AND t.at_ms <= r.at_ms
    AND t.event IN ('enqueue', 'dequeue', 'retry_requeue') ORDER BY t.at_ms DESC, t.seq DESC LIMIT 1) s ON true"""
_RESOLVED = f"""SELECT task_id, request_id, at_ms, coalesce(state IN ('enqueue', 'retry_requeue'), false)
  AND row_number() OVER (PARTITION BY task_id, since ORDER BY at_ms) = 1 AS cancelled FROM ({_CANCEL}) c"""


@query("cancel_resolution", _RESOLVED)
def _(spark, sf):
    return ops.cancel_resolution(trace(spark, sf), _cancels(spark, sf))


@query(
    "surviving_queue",
    f"""SELECT o_orderkey AS task_id FROM orders WHERE o_orderkey % 19 = 0
      AND o_orderkey NOT IN (SELECT task_id FROM ({_RESOLVED}) r WHERE cancelled)""",
)
def _(spark, sf):
    rows = trace(spark, sf)
    return ops.surviving_queue(rows, ops.cancel_resolution(rows, _cancels(spark, sf)))


@query(
    "task_result_lines",
    """SELECT line_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' task_id=' || task_id || ' status=' || status || ' tag=' || tag
      || ' type=- worker=' || coalesce(CAST(worker AS VARCHAR), '-') || ' duration_us=' || coalesce(CAST(duration_us AS VARCHAR), '-')
      || ' detail=attempt ' || attempt || ' of 3: tag=not_this_one' AS text FROM task_good""",
)
def _(spark, sf):
    rows = ops.accepted(parsed(spark, sf)).withColumn("type", F.lit(""))
    ms = F.coalesce(F.col("duration_us") / 1000, F.lit(-1.0))
    row = {c: F.col(c) for c in ("ts", "task_id", "status", "tag", "type", "detail")}
    row["worker"] = F.coalesce("worker", F.lit(-1))
    row["duration_us"] = ops.ms_to_us(ms)
    return rows.select("line_id", ops.task_result_text(row).alias("text"))


_MS = "CAST(p95_us // 1000 AS VARCHAR) || '.' || lpad(CAST(p95_us % 1000 AS VARCHAR), 3, '0')"


@query(
    "export_tag_stats_csv",
    f"""SELECT * FROM (WITH b AS ({_BLOCKS}), p AS ({_P95}),
      v AS (SELECT b.*, name || ',' || ok || ',' || failed || ',' || retrying || ',' || cancelled || ',' || total AS line, {_MS} AS p95
        FROM b LEFT JOIN p ON b.block = 'tag' AND p.tag = b.name)
      SELECT 0 AS section, '0' AS place, 'log_file,results_19970101.log' AS text
      UNION ALL SELECT 0, '1', 'file_found,true'
      UNION ALL SELECT 0, '2', 'lines_total,' || (SELECT count(*) FROM orders)
      UNION ALL SELECT 0, '3', 'lines_parsed,' || (SELECT count(*) FROM task_good)
      UNION ALL SELECT 0, '4', 'lines_skipped,' || ((SELECT count(*) FROM orders) - (SELECT count(*) FROM task_good))
      UNION ALL SELECT 1, '', 'tag,ok,failed,retrying,cancelled,total,p95_duration_ms'
      UNION ALL SELECT 4, '', 'worker,ok,failed,retrying,cancelled,total'
      UNION ALL SELECT CASE WHEN name = 'TOTAL' THEN 3 ELSE 2 END, name, line || ',' || coalesce(p95, '') FROM v WHERE block = 'tag'
      UNION ALL SELECT CASE WHEN name = 'TOTAL' THEN 6 ELSE 5 END, lpad(name, 12, '0'), line FROM v WHERE block = 'worker') z""",
)
def _(spark, sf):
    return ops.export_tag_stats_csv(parsed(spark, sf), "results_19970101.log")


_NUMBERS = """'"ok": ' || ok || ', "failed": ' || failed || ', "retrying": ' || retrying || ', "cancelled": ' || cancelled || ', "total": ' || total"""


@query(
    "export_tag_stats_json",
    f"""SELECT * FROM (WITH b AS ({_BLOCKS}), p AS ({_P95}),
      v AS (SELECT b.*, {_NUMBERS} AS nums, {_MS} AS p95, name = 'TOTAL' AS tot,
          CASE WHEN block = 'worker' THEN lpad(name, 12, '0') ELSE name END AS place FROM b LEFT JOIN p ON b.block = 'tag' AND p.tag = b.name),
      t AS (SELECT *, place = max(place) OVER (PARTITION BY block) AS fin FROM v WHERE NOT tot)
      SELECT 0 AS section, '0' AS place, '{{' AS text
      UNION ALL SELECT 0, '1', '  "log_file": "results_19970101.log",'
      UNION ALL SELECT 0, '2', '  "file_found": true,'
      UNION ALL SELECT 0, '3', '  "lines_total": ' || (SELECT count(*) FROM orders) || ','
      UNION ALL SELECT 0, '4', '  "lines_parsed": ' || (SELECT count(*) FROM task_good) || ','
      UNION ALL SELECT 0, '5', '  "lines_skipped": ' || ((SELECT count(*) FROM orders) - (SELECT count(*) FROM task_good)) || ','
      UNION ALL SELECT 1, '', '  "tags": ['
      UNION ALL SELECT 2, place, '    {{"tag": "' || name || '", ' || nums || ', "p95_duration_ms": ' || coalesce(p95, 'null') || '}}'
        || CASE WHEN fin THEN '' ELSE ',' END FROM t WHERE block = 'tag'
      UNION ALL SELECT 3, '0', '  ],'
      UNION ALL SELECT 3, '1', '  "workers": ['
      UNION ALL SELECT 4, place, '    {{"worker": ' || name || ', ' || nums || '}}' || CASE WHEN fin THEN '' ELSE ',' END FROM t WHERE block = 'worker'
      UNION ALL SELECT 5, '', '  ],'
      UNION ALL SELECT 6, '', '  "total": {{' || nums || '}}' FROM v WHERE tot AND block = 'tag'
      UNION ALL SELECT 7, '', '}}') z""",
)
def _(spark, sf):
    return ops.export_tag_stats_json(parsed(spark, sf), "results_19970101.log")
