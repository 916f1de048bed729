"""Registered streaming queries: each runs its flow over all data there is and
returns what the flow wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import logline as L
from opslens.operators import logs as ops
from opslens.plans import logs as batch
from opslens.plans import results as batch_results
from opslens.plans.oracle import sql
from opslens.session import fresh_dir
from opslens.sources import views
from opslens.streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle if oracle.startswith("WITH RECURSIVE") else sql(oracle)
        return build

    return register


def _stream(spark, sf, table):
    schema = views.table(spark, sf, table).schema
    # A file source takes a folder or a pattern, not one file.
    return flows.stream_table(spark, f"{sf}/[{table[0]}]{table[1:]}.parquet", schema)


def log_stream(spark, sf):
    return _stream(spark, sf, "events").select(*views.log_line_columns())


@query("stream_log_lines", "SELECT source, source_type, count(*) AS lines FROM log_lines GROUP BY source, source_type")
def _(spark, sf):
    out = fresh_dir(spark, "stream_log_lines")
    flows.land_lines(log_stream(spark, sf), out)
    return flows.read_batches(spark, out).groupBy("source", "source_type").agg(F.count(F.lit(1)).alias("lines"))


def _log_flow(spark, sf):
    out = fresh_dir(spark, "stream_log_flow")
    flows.stream_log_flow(
        log_stream(spark, sf),
        out,
        batch.ROUTES,
        limit=batch.LIMIT,
        threshold=1,
        keyword="E",
        predicate=lambda r: ~L.kv_pred(r["fields"], "type", "=", "VIEW"),
        custom=batch.CUSTOM,
        tags=ops.tag_table(spark, batch.TAGS),
    )
    return out


@query("stream_log_flow", batch.ORACLES["fan_out"])
def _(spark, sf):
    return flows.read_batches(spark, _log_flow(spark, sf)).select("source", "line_no", "output", "line")


@query(
    "stream_flow_counters",
    """SELECT family, label, CAST(n AS BIGINT) AS n FROM (
      SELECT 'disposition' AS family, CASE WHEN NOT admitted THEN 'rate_dropped' WHEN stage IS NOT NULL THEN 'filtered'
        WHEN d.source IS NULL THEN 'unrouted' ELSE 'written' END AS label, count(*) AS n FROM log_staged s
        LEFT JOIN (SELECT DISTINCT source, line_no FROM log_routed) d ON d.source = s.source AND d.line_no = s.line_no GROUP BY 2
      UNION ALL SELECT 'source', source, count(*) FROM log_limited WHERE admitted GROUP BY source
      UNION ALL SELECT 'level', CASE WHEN severity >= 4 THEN 'RAW' ELSE ['DEBUG', 'INFO', 'WARN', 'ERROR'][severity + 1] END, count(*)
        FROM log_records GROUP BY 2
      UNION ALL SELECT 'kv', 'attempted', count(*) FROM log_limited WHERE admitted
      UNION ALL SELECT 'kv', 'extracted', count(DISTINCT line_id) FROM log_kv
      UNION ALL SELECT 'kv', 'fields', count(*) FROM log_kv
      UNION ALL SELECT 'output_lines', output, count(*) FROM log_written GROUP BY output
      UNION ALL SELECT 'output_bytes', output, sum(strlen(line) + 1) FROM log_written GROUP BY output) x""",
)
def _(spark, sf):
    return flows.flow_counters(spark, _log_flow(spark, sf)).select("family", "label", "n")


@query("stream_rate_limit", batch.ORACLES["rate_limit_anchored"])
def _(spark, sf):
    out = fresh_dir(spark, "stream_rate_limit")
    flows.stream_rate_limit(log_stream(spark, sf), out, batch.LIMIT)
    return flows.read_limited(spark, out).select("line_id", "window_start", "admitted")


@query(
    "stream_counters",
    "SELECT CASE WHEN severity >= 4 THEN 'RAW' ELSE ['DEBUG', 'INFO', 'WARN', 'ERROR'][severity + 1] END AS level, count(*) AS lines FROM log_records GROUP BY 1",
)
def _(spark, sf):
    out = fresh_dir(spark, "stream_counters")
    flows.stream_counters(log_stream(spark, sf), out, batch.CUSTOM)
    return flows.last_snapshot(spark, out).select("level", "lines")


@query(
    "stream_window_counts",
    "SELECT strftime(date_trunc('hour', ingested_ts), '%Y-%m-%d %H:%M:%S') AS hour, level, count(*) AS lines FROM log_records GROUP BY 1, 2",
)
def _(spark, sf):
    out = fresh_dir(spark, "stream_window_counts")
    flows.stream_window_counts(log_stream(spark, sf), out, "ingested_ts", "1 hour", "1 day", batch.CUSTOM)
    counts = flows.latest(flows.read_batches(spark, out), ["window_start", "level"])
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "level", "lines")


@query(
    "stream_kv_top_n",
    """SELECT key, value, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cnt DESC, value) AS rank FROM (
      SELECT key, value, count(*) AS cnt FROM (
        SELECT unnest(['user', 'type', 'note']) AS key, unnest(['u' || user_id, event_type, regexp_extract(text, 'note="([^"]*)"', 1)]) AS value
        FROM log_lines WHERE shape = 'plain'
        UNION ALL SELECT unnest(['job', 'status', 'id']), unnest(['sync', 'done', CAST(line_id AS VARCHAR)]) FROM log_lines WHERE shape = 'pure') k
      WHERE key <> 'note' OR value <> '' GROUP BY key, value) c) r WHERE rank <= 10""",
)
def _(spark, sf):
    out = fresh_dir(spark, "stream_kv_top_n")
    flows.stream_kv_counts(log_stream(spark, sf), out, batch.CUSTOM)
    return flows.kv_top_n(spark, out)


@query("stream_result_stats", batch_results.ORACLES["tag_status_stats"])
def _(spark, sf):
    out = fresh_dir(spark, "stream_result_stats")
    lines = _stream(spark, sf, "orders").select(*views.task_result_columns())
    flows.stream_result_stats(lines, out)
    return flows.latest(flows.read_batches(spark, out), ["tag"])
