"""Registered queries of the log family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import logline as L
from opslens.functions import text as T
from opslens.operators import logs as ops
from opslens.operators import ordered as O
from opslens.plans.oracle import crc32, sql
from opslens.session import fresh_dir
from opslens.sources import readers, sinks, views

CUSTOM = {"AUDIT": 7}
TAGS = {"logs/app_0.log": "env=prod,tier=edge", "logs/app_1.log": "env=test,user=tagged,canary"}
ROUTES = [
    L.Route("warnings", min_severity=2),
    L.Route("errors", min_severity=3, chain=L.steps("uppercase"), format="json"),
    L.Route(
        "note",
        predicate=lambda r: L.text_pred(r["message"], "starts_with", "event")
        & L.kv_pred(r["fields"], "note", "contains", "TOOK 4")
        & L.kv_pred(r["fields"], "step", "=", "renamed"),
        chain=L.steps("replace:evt->EVENT|tag:step=renamed"),
        position="before",
    ),
]
LIMIT = 2
SINCE_MS = 1_705_000_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = sql(oracle)
        return build

    return register


def records(spark, sf):
    return ops.parse_log_line(views.log_lines(spark, sf), CUSTOM)


def flow(spark, sf):
    return ops.log_flow(
        views.log_lines(spark, sf),
        ROUTES,
        limit=LIMIT,
        threshold=1,
        keyword="E",
        predicate=lambda r: ~L.kv_pred(r["fields"], "type", "=", "VIEW"),
        custom=CUSTOM,
        tags=ops.tag_table(spark, TAGS),
    )


@query("parse_log_line", "SELECT line_id, parsed, CAST(severity AS BIGINT) AS severity, level, ts_text, message FROM log_records")
def _(spark, sf):
    return records(spark, sf).select(
        "line_id", "parsed", F.col("severity").cast("bigint").alias("severity"), "level", "ts_text", "message"
    )


@query(
    "level_severity",
    """SELECT word, CAST(max(sev) AS BIGINT) AS severity, count(*) AS lines FROM (
      SELECT CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'notice'
          WHEN 'purchase' THEN 'Warning' ELSE 'AUDIT' END AS word,
        CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS sev
      FROM events WHERE event_id % 17 <> 0 AND event_id % 23 <> 0) x GROUP BY word""",
)
def _(spark, sf):
    words = views.log_lines(spark, sf).select(F.regexp_extract("text", L.LINE, 2).alias("word"))
    return (
        words.where(F.col("word") != "")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select("word", L.severity_of(F.col("word")).cast("bigint").alias("severity"), "lines")
    )


@query(
    "register_levels",
    """WITH r AS (SELECT event_id AS seq,
        CASE WHEN user_id % 20 = 3 THEN '' WHEN user_id % 20 = 5 THEN 'warn' ELSE upper(event_type) || (user_id % 6) END AS name,
        CASE WHEN user_id % 20 = 7 THEN 1000 WHEN user_id % 50 = 11 THEN user_id % 900 ELSE user_id % 6 + 10 END AS value
      FROM events),
    f AS (SELECT *, CASE WHEN name = '' THEN 'empty name' WHEN name = 'warn' THEN 'built-in name'
        WHEN value < 1 OR value > 999 THEN 'value out of range' END AS fault FROM r),
    w AS (SELECT *, first_value(value) OVER (PARTITION BY name, fault IS NULL ORDER BY seq) AS reg FROM f)
    SELECT seq, name, CAST(value AS BIGINT) AS value,
      coalesce(fault, CASE WHEN value <> reg THEN 'already registered' END) AS error FROM w""",
)
def _(spark, sf):
    return ops.register_levels(views.level_requests(spark, sf))


@query("filter_min_level", "SELECT line_id, CAST(severity AS BIGINT) AS severity FROM log_records WHERE severity >= 3")
def _(spark, sf):
    return records(spark, sf).where(F.col("severity") >= 3).select("line_id", F.col("severity").cast("bigint").alias("severity"))


@query("filter_keyword", "SELECT line_id, message FROM log_records WHERE lower(message) LIKE '%type=click%'")
def _(spark, sf):
    return records(spark, sf).where(L.keyword_pred(F.col("message"), "Type=CLICK")).select("line_id", "message")


@query(
    "filter_staged",
    """SELECT coalesce(stage, 'passed') AS stage, count(*) AS lines FROM (
      SELECT CASE WHEN strpos(message, 'note=') > 0 THEN 'predicate' WHEN severity < 2 THEN 'level'
        WHEN strpos(lower(message), 'user=u1') = 0 THEN 'keyword' END AS stage FROM log_records) x GROUP BY 1""",
)
def _(spark, sf):
    stage = ops.drop_stage(
        F.col("severity"), F.col("message"), ~L.text_pred(F.col("message"), "contains", "NOTE="), 2, "USER=U1"
    )
    return (
        records(spark, sf)
        .groupBy(F.coalesce(stage, F.lit("passed")).alias("stage"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "pred_level_cmp",
    """SELECT line_id, severity = 2 AS is_warn, severity <> 3 AS not_error, severity >= 2 AS from_warn, severity < 1 AS below_info,
      severity > 3 AS above_error, severity <= 7 AS upto_audit FROM log_records""",
)
def _(spark, sf):
    s = F.col("severity")
    return records(spark, sf).select(
        "line_id",
        L.level_pred(s, "=", "warning").alias("is_warn"),
        L.level_pred(s, "!=", "ERR").alias("not_error"),
        L.level_pred(s, ">=", "WARN").alias("from_warn"),
        L.level_pred(s, "<", "info").alias("below_info"),
        L.level_pred(s, ">", "fatal").alias("above_error"),
        L.level_pred(s, "<=", "audit", CUSTOM).alias("upto_audit"),
    )


@query(
    "pred_eq_ci",
    """SELECT lang, count(*) AS docs, count(*) FILTER (WHERE translate(source,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') = 'web') AS eq_web,
      count(*) FILTER (WHERE lang <> 'fr') AS ne_fr FROM documents GROUP BY lang""",
)
def _(spark, sf):
    return (
        views.documents(spark, sf)
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.count_if(L.text_pred(F.col("source"), "=", "WEB")).alias("eq_web"),
            F.count_if(L.text_pred(F.col("lang"), "!=", "FR")).alias("ne_fr"),
        )
    )


@query(
    "pred_lex_cmp",
    "SELECT line_id, message >= 'evt user=u2' AS ge, source < 'logs/app_2' AS lt, message > 'job' AS gt, source <= 'logs/app_1.log' AS le FROM log_records",
)
def _(spark, sf):
    m, s = F.col("message"), F.col("source")
    return records(spark, sf).select(
        "line_id",
        L.text_pred(m, ">=", "evt user=u2").alias("ge"),
        L.text_pred(s, "<", "logs/app_2").alias("lt"),
        L.text_pred(m, ">", "job").alias("gt"),
        L.text_pred(s, "<=", "logs/app_1.log").alias("le"),
    )


_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "pred_text_match_ci",
    f"""SELECT doc_id, strpos({_FOLDED}, 'école') > 0 OR strpos({_FOLDED}, 'les') > 0 AS has, starts_with({_FOLDED}, 'e') AS starts,
      suffix({_FOLDED}, 'en.') AS ends FROM documents""",
)
def _(spark, sf):
    t = F.col("text")
    return views.documents(spark, sf).select(
        "doc_id",
        (L.text_pred(t, "contains", "éCOLE") | L.text_pred(t, "contains", "LES")).alias("has"),
        L.text_pred(t, "starts_with", "E").alias("starts"),
        L.text_pred(t, "ends_with", "EN.").alias("ends"),
    )


@query("pred_regex", "SELECT line_id FROM log_records WHERE regexp_matches(message, 'user=u[0-9]5 type=(view|error)')")
def _(spark, sf):
    pattern = L.check_regex(spark, "user=u[0-9]5 type=(view|error)")
    return records(spark, sf).where(L.text_pred(F.col("message"), "matches", pattern)).select("line_id")


@query(
    "pred_kv",
    """SELECT line_id, note LIKE '%took%' AS has, note <> '' AND note <> 'took 7 ms' AS differs,
      NOT (note = 'took 7 ms') AS not_equal, note > 'took 5' AS above
    FROM (SELECT line_id, CASE WHEN shape = 'plain' THEN regexp_extract(text, 'note="([^"]*)"', 1) ELSE '' END AS note FROM log_records) x""",
)
def _(spark, sf):
    rows = records(spark, sf).withColumn("kv", L.kv_cascade(F.col("text"), F.col("message"), F.col("parsed")))
    kv = F.col("kv")
    return rows.select(
        "line_id",
        L.kv_pred(kv, "note", "contains", "TOOK").alias("has"),
        L.kv_pred(kv, "note", "!=", "TOOK 7 MS").alias("differs"),
        (~L.kv_pred(kv, "note", "=", "TOOK 7 MS")).alias("not_equal"),
        L.kv_pred(kv, "note", ">", "took 5").alias("above"),
    )


@query(
    "pred_compose",
    """SELECT line_id FROM log_records WHERE (severity >= 2 AND NOT (shape = 'plain' AND event_type = 'error')) OR source = 'logs/app_3.log'""",
)
def _(spark, sf):
    rows = records(spark, sf).withColumn("kv", L.kv_cascade(F.col("text"), F.col("message"), F.col("parsed")))
    wanted = (
        L.level_pred(F.col("severity"), ">=", "WARN") & ~L.kv_pred(F.col("kv"), "type", "=", "Error")
    ) | L.text_pred(F.col("source"), "=", "LOGS/APP_3.LOG")
    return rows.where(wanted).select("line_id")


@query(
    "transform_chain",
    """SELECT line_id, replace(upper(message), 'EVT', 'event') AS message, 'web-01' AS host,
      CASE WHEN shape = 'plain' THEN 'changed' WHEN shape = 'pure' THEN 'changed' ELSE 'changed' END AS type FROM log_records""",
)
def _(spark, sf):
    rows = records(spark, sf).withColumn("kv", L.kv_cascade(F.col("text"), F.col("message"), F.col("parsed")))
    padded = F.concat(F.lit(" \t"), F.col("message"), F.lit(" \r"))
    chain = L.steps("trim|uppercase|replace:EVT->event|tag:host=web-01|tag:type=changed")
    message, fields = L.transformed(padded, F.col("kv"), chain)
    return rows.select(
        "line_id", message.alias("message"), fields["host"].alias("host"), fields["type"].alias("type")
    )


@query(
    "transform_position",
    """SELECT line_id, m || p AS output FROM (
      SELECT line_id, message, unnest(['b:', 'a:']) AS m, unnest([replace(message, 'evt', 'EVENT'), '']) AS p FROM log_records) x
      WHERE m = 'b:' AND p LIKE 'EVENT%'""",
)
def _(spark, sf):
    chain = L.steps("replace:evt->EVENT")
    wanted = lambda r: F.startswith(r["message"], F.lit("EVENT"))
    routes = [L.Route("b", 0, wanted, chain, "before"), L.Route("a", 0, wanted, chain, "after")]
    empty = F.create_map().cast("map<string,string>")
    rows = records(spark, sf).withColumn("fields", empty)
    record = {c: F.col(c) for c in ("source", "severity", "level", "ts_text", "message", "fields")}
    offered = rows.select("line_id", *record.values(), F.explode(ops.accepting_routes(record, routes)).alias("output"))
    message = F.regexp_extract(ops.route_line(record, routes, F.col("output")), r"\] ([^\]]*) \|crc=", 1)
    return offered.select("line_id", F.concat(F.col("output"), F.lit(":"), message).alias("output"))


@query(
    "fan_out",
    "SELECT source, line_no, output, line FROM log_written",
)
def _(spark, sf):
    return ops.fan_out(flow(spark, sf), ROUTES).select("source", "line_no", "output", "line")


@query(
    "union_sources",
    """SELECT source_type, count(*) AS lines FROM (SELECT source_type FROM log_lines UNION ALL
      SELECT 'stdin' FROM conversations) x GROUP BY source_type""",
)
def _(spark, sf):
    lines = views.log_lines(spark, sf)
    console = views.table(spark, sf, "conversations").select(
        F.lit("stdin").alias("source"), F.monotonically_increasing_id().alias("line_no"), F.col("text")
    )
    return (
        readers.union_sources(
            file=lines.where("source_type = 'file'"), glob=lines.where("source_type = 'glob'"), stdin=console
        )
        .groupBy("source_type")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


# --- enrichment ---------------------------------------------------------------


@query(
    "attach_source_tags",
    """SELECT source, count(*) AS lines, max(CASE source WHEN 'logs/app_0.log' THEN 'prod' WHEN 'logs/app_1.log' THEN 'test' END) AS env,
      max(CASE source WHEN 'logs/app_1.log' THEN 'true' END) AS canary FROM log_lines GROUP BY source""",
)
def _(spark, sf):
    tagged = ops.attach_source_tags(views.log_lines(spark, sf), ops.tag_table(spark, TAGS))
    return tagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max(F.try_element_at("tags", F.lit("env"))).alias("env"),
        F.max(F.try_element_at("tags", F.lit("canary"))).alias("canary"),
    )


@query(
    "merge_fields",
    """SELECT line_id, CASE WHEN shape = 'plain' THEN 'u' || user_id WHEN source = 'logs/app_1.log' THEN 'tagged' END AS user,
      CASE source WHEN 'logs/app_0.log' THEN 'prod' WHEN 'logs/app_1.log' THEN 'test' END AS env FROM log_records""",
)
def _(spark, sf):
    tagged = ops.attach_source_tags(records(spark, sf), ops.tag_table(spark, TAGS))
    kv = L.kv_cascade(F.col("text"), F.col("message"), F.col("parsed"))
    merged = tagged.withColumn("fields", L.merge_maps(F.col("tags"), kv))
    return merged.select(
        "line_id",
        F.try_element_at("fields", F.lit("user")).alias("user"),
        F.try_element_at("fields", F.lit("env")).alias("env"),
    )


@query(
    "kv_extract",
    """SELECT line_id, 3 AS n, 'sync' AS job, 'done' AS status, CAST(line_id AS VARCHAR) AS id FROM log_lines WHERE shape = 'pure'""",
)
def _(spark, sf):
    kv = L.kv_strict(F.col("text"))
    return (
        views.log_lines(spark, sf)
        .withColumn("kv", kv)
        .where(F.size("kv") > 0)
        .select(
            "line_id",
            F.size("kv").alias("n"),
            F.try_element_at("kv", F.lit("job")).alias("job"),
            F.try_element_at("kv", F.lit("status")).alias("status"),
            F.try_element_at("kv", F.lit("id")).alias("id"),
        )
    )


@query(
    "kv_extract_tail",
    """SELECT line_id, CASE WHEN line_id % 7 = 0 THEN 3 ELSE 2 END AS n, 'u' || user_id AS user, event_type AS type,
      CASE WHEN line_id % 7 = 0 THEN 'took ' || CAST(line_id % 100 AS VARCHAR) || ' ms' END AS note FROM log_lines WHERE shape = 'plain'""",
)
def _(spark, sf):
    return (
        records(spark, sf)
        .where("parsed")
        .withColumn("kv", L.kv_tail(F.col("message")))
        .select(
            "line_id",
            F.size("kv").alias("n"),
            *[F.try_element_at("kv", F.lit(k)).alias(k) for k in ("user", "type", "note")],
        )
    )


@query(
    "kv_cascade",
    """SELECT line_id, CASE WHEN shape = 'noise' THEN 0 WHEN shape = 'pure' THEN 3 WHEN line_id % 7 = 0 THEN 3 ELSE 2 END AS n FROM log_lines""",
)
def _(spark, sf):
    kv = L.kv_cascade(F.col("text"), F.col("message"), F.col("parsed"))
    return records(spark, sf).select("line_id", F.size(kv).alias("n"))


# --- counters -----------------------------------------------------------------


@query(
    "level_counts",
    """SELECT n.level, CAST(n.severity AS BIGINT) AS severity, count(r.line_id) AS lines
    FROM (VALUES ('DEBUG',0),('INFO',1),('WARN',2),('ERROR',3),('RAW',4)) n(level, severity)
    LEFT JOIN log_records r ON least(r.severity, 4) = n.severity GROUP BY n.level, n.severity""",
)
def _(spark, sf):
    return ops.level_counts(records(spark, sf))


@query(
    "disposition_counters",
    """SELECT (SELECT count(*) FROM log_staged) AS ingested,
      (SELECT count(*) FROM log_staged WHERE NOT admitted) AS rate_dropped,
      (SELECT count(*) FROM log_staged WHERE stage IS NOT NULL) AS filtered,
      (SELECT count(*) FROM log_staged WHERE admitted AND stage IS NULL)
        - (SELECT count(*) FROM (SELECT DISTINCT source, line_no FROM log_routed) d) AS unrouted,
      (SELECT count(*) FROM (SELECT DISTINCT source, line_no FROM log_routed) d) AS written_records,
      (SELECT count(*) FROM log_routed) AS written_lines,
      (SELECT CAST(sum(strlen(line) + 1) AS BIGINT) FROM log_written) AS written_bytes""",
)
def _(spark, sf):
    return ops.disposition_counters(flow(spark, sf), ROUTES)


@query(
    "source_counters",
    """SELECT s.source, s.lines, CAST(coalesce(w.b, 0) AS BIGINT) AS written_bytes FROM
      (SELECT source, count(*) AS lines FROM log_limited WHERE admitted GROUP BY source) s
      LEFT JOIN (SELECT source, sum(strlen(line) + 1) AS b FROM log_written GROUP BY source) w ON s.source = w.source""",
)
def _(spark, sf):
    return ops.source_counters(flow(spark, sf), ROUTES)


@query(
    "source_type_counters",
    "SELECT source_type, count(*) AS lines, count(DISTINCT source) AS active_sources FROM log_lines GROUP BY source_type",
)
def _(spark, sf):
    return ops.source_type_counters(views.log_lines(spark, sf))


@query(
    "output_counters",
    "SELECT output, count(*) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM log_written GROUP BY output",
)
def _(spark, sf):
    return ops.output_counters(flow(spark, sf), ROUTES)


@query(
    "kv_extraction_rate",
    """SELECT attempted, extracted, fields, (extracted * 100 + attempted // 2) // attempted AS percent FROM (
      SELECT (SELECT count(*) FROM log_limited WHERE admitted) AS attempted,
        (SELECT count(*) FROM (SELECT DISTINCT line_id FROM log_kv) d) AS extracted,
        (SELECT count(*) FROM log_kv) AS fields) x""",
)
def _(spark, sf):
    return ops.kv_extraction_rate(flow(spark, sf))


@query("kv_value_counts", "SELECT key, value, count(*) AS cnt FROM log_kv GROUP BY key, value")
def _(spark, sf):
    return ops.kv_value_counts(flow(spark, sf))


@query(
    "kv_top_n",
    """SELECT key, value, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cnt DESC, value) AS rank FROM
      (SELECT key, value, count(*) AS cnt FROM log_kv GROUP BY key, value) c) r WHERE rank <= 10""",
)
def _(spark, sf):
    return ops.kv_top_n(ops.kv_value_counts(flow(spark, sf)), 10)


@query(
    "retention_prune",
    """SELECT base, name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY name DESC) AS rn FROM (
      SELECT CASE WHEN event_id % 3 = 0 THEN 'main' ELSE 'job' || (event_id % 7) END AS base,
        CASE WHEN event_id % 3 = 0 THEN 'main' ELSE 'job' || (event_id % 7) END || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_id || '.prom' AS name
      FROM events WHERE event_id % 29 <> 0) e) r WHERE rn > 24""",
)
def _(spark, sf):
    return ops.retention_prune(views.exports(spark, sf), 24)


# --- limits, replay, index --------------------------------------------------------


@query("rate_limit_aligned", "SELECT line_id, admitted FROM log_limited")
def _(spark, sf):
    return ops.rate_limit_aligned(views.log_lines(spark, sf), LIMIT).select("line_id", "admitted")


@query(
    "rate_limit_anchored",
    """SELECT line_id, w AS window_start, row_number() OVER (PARTITION BY source, w ORDER BY ts_ms, line_no) <= 2 AS admitted FROM (
      WITH RECURSIVE chain AS (
        SELECT source, min(ts_ms) AS w FROM log_lines GROUP BY source
        UNION ALL
        SELECT c.source, n.t FROM chain c JOIN LATERAL (SELECT min(l.ts_ms) AS t FROM log_lines l
          WHERE l.source = c.source AND l.ts_ms >= c.w + 1000 AND l.ts_ms < c.w + 3000) n ON n.t IS NOT NULL)
      SELECT l.line_id, l.source, l.ts_ms, l.line_no, c.w FROM log_lines l ASOF JOIN chain c ON l.source = c.source AND l.ts_ms >= c.w) x""",
)
def _(spark, sf):
    limited = ops.rate_limit_anchored(views.log_lines(spark, sf), LIMIT)
    return limited.select("line_id", "window_start", "admitted")


_IN_LINE = "CASE WHEN shape = 'plain' THEN epoch_ms(date_trunc('second', ingested_ts)) END"


@query(
    "replay_since",
    f"""SELECT l.line_id FROM log_lines l JOIN (SELECT source, min(line_no) AS a FROM log_lines
      WHERE {_IN_LINE} >= {SINCE_MS} GROUP BY source) s ON l.source = s.source AND l.line_no >= s.a""",
)
def _(spark, sf):
    return ops.replay_since(views.log_lines(spark, sf), SINCE_MS).select("line_id")


_SKIPPED = f"""SELECT l.source, CAST(sum(CASE WHEN s.a IS NULL OR l.line_no < s.a THEN strlen(text) + 1 ELSE 0 END) AS BIGINT) AS skipped_bytes
      FROM log_lines l LEFT JOIN (SELECT source, min(line_no) AS a FROM log_lines WHERE {_IN_LINE} >= {SINCE_MS} GROUP BY source) s
      ON l.source = s.source GROUP BY l.source"""


@query("replay_skipped_bytes", _SKIPPED)
def _(spark, sf):
    return ops.replay_skipped_bytes(views.log_lines(spark, sf), SINCE_MS)


_OFFSETS = f"""offs AS (SELECT source, line_no,
    CAST(sum(strlen(text) + 1) OVER w AS BIGINT) AS fin, strlen(text) + 1 AS size,
    coalesce(last_value({_IN_LINE} IGNORE NULLS) OVER w, 0) AS last_ts_ms
  FROM log_lines WINDOW w AS (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  idx AS (SELECT source, unnest(range((fin - size) // 4096 + 1, fin // 4096 + 1)) * 4096 AS mark, last_ts_ms FROM offs)"""


def _index(spark, sf):
    return ops.build_line_index(ops.line_offsets(views.log_lines(spark, sf), 1 << 16), 4096)


@query("build_line_index", f"SELECT * FROM (WITH {_OFFSETS} SELECT source, mark, last_ts_ms FROM idx) z")
def _(spark, sf):
    return _index(spark, sf)


_PROBES = "probes AS (SELECT DISTINCT source, epoch_ms(date_trunc('hour', ingested_ts)) - 1800000 AS since_ms FROM log_lines)"


def _probes(spark, sf):
    at = F.unix_millis(F.date_trunc("hour", F.col("ingested_ts")).cast("timestamp")) - 1800000
    return views.log_lines(spark, sf).select("source", at.alias("since_ms")).distinct()


@query(
    "index_seek",
    f"""SELECT * FROM (WITH {_OFFSETS}, {_PROBES}
      SELECT p.source, p.since_ms,
        (SELECT arg_max(mark, (last_ts_ms, mark)) FROM idx i WHERE i.source = p.source AND i.last_ts_ms <= p.since_ms) AS start_mark,
        (SELECT arg_min(mark, (last_ts_ms, mark)) FROM idx i WHERE i.source = p.source AND i.last_ts_ms >= p.since_ms) AS next_mark
      FROM probes p) z""",
)
def _(spark, sf):
    return ops.index_seek(_index(spark, sf), _probes(spark, sf))


_POSITIONS = f"""SELECT * FROM (WITH {_OFFSETS},
      m AS (SELECT source, arg_max(mark, (last_ts_ms, mark)) AS mark FROM idx WHERE last_ts_ms <= {SINCE_MS} GROUP BY source)
      SELECT o.source, CASE WHEN max(m.mark) IS NULL THEN 'fallback' ELSE 'index' END AS positioned_by,
        coalesce(max(m.mark), 0) AS mark, coalesce(max(CASE WHEN o.fin - o.size <= m.mark THEN o.fin - o.size END), 0) AS start_offset
      FROM offs o LEFT JOIN m ON m.source = o.source GROUP BY o.source) z"""


@query("replay_positioning", _POSITIONS)
def _(spark, sf):
    offsets = ops.line_offsets(views.log_lines(spark, sf), 1 << 16)
    return ops.replay_positioning(offsets, ops.build_line_index(offsets, 4096), SINCE_MS)


def _written(spark, sf):
    """All records as text lines: ``output, day, seq, line, bytes``."""
    line = L.text_line(F.col("ts_text"), F.col("level"), F.col("source"), F.col("message"))
    return (
        records(spark, sf)
        .select(
            T.safe_source_name(F.col("source")).alias("output"),
            F.date_format("ingested_ts", "yyyyMMdd").alias("day"),
            F.col("line_no").alias("seq"),
            line.alias("line"),
        )
        .withColumn("bytes", ops.line_size(F.col("line")))
    )


def _plan(spark, sf, block):
    return ops.size_rotation_plan(_written(spark, sf).select("output", "day", "seq", "bytes"), 2000, 40, block)


_ROTATION = """SELECT output, day, file_no, lines, bytes FROM (
      WITH RECURSIVE w AS (SELECT replace(replace(source, 'logs/', ''), '.', '_') AS output, strftime(ingested_ts, '%Y%m%d') AS day,
          row_number() OVER (PARTITION BY source, strftime(ingested_ts, '%Y%m%d') ORDER BY line_no) AS rn,
          strlen(ts_text) + strlen(level) + strlen(source) + strlen(message) + 7 + 15 AS b FROM log_records),
      fold AS (
        SELECT output, day, rn, b, CASE WHEN b + 40 > 2000 THEN 1 ELSE 0 END AS file_no, 40 + b AS used FROM w WHERE rn = 1
        UNION ALL
        SELECT w.output, w.day, w.rn, w.b, CASE WHEN f.used + w.b > 2000 THEN f.file_no + 1 ELSE f.file_no END,
          CASE WHEN f.used + w.b > 2000 THEN 40 + w.b ELSE f.used + w.b END
        FROM fold f JOIN w ON w.output = f.output AND w.day = f.day AND w.rn = f.rn + 1)
      SELECT output, day, CAST(file_no AS BIGINT) AS file_no, count(*) AS lines, CAST(sum(b) AS BIGINT) AS bytes FROM fold GROUP BY 1, 2, 3) z"""


@query("size_rotation_plan", _ROTATION)
def _(spark, sf):
    plan = _plan(spark, sf, 64)
    return plan.groupBy("output", "day", "file_no").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes")
    )


_PROM = " UNION ALL ".join(
    [
        "SELECT 0 AS family_no, 2 AS kind, '{level=\"' || level || '\"}' AS label, 'lines_ingested_total' AS fam, lines AS v FROM lv",
        "SELECT 0, 3, '', 'lines_ingested_total', (SELECT count(*) FROM log_staged)",
        "SELECT 1, 3, '', 'lines_filtered_total', (SELECT count(*) FROM log_staged WHERE stage IS NOT NULL)",
        "SELECT 2, 3, '', 'lines_written_total', (SELECT count(*) FROM (SELECT DISTINCT source, line_no FROM log_routed) d)",
        "SELECT 3, 3, '', 'output_bytes_total', (SELECT CAST(sum(strlen(line) + 1) AS BIGINT) FROM log_written)",
        "SELECT 4, 3, '', 'lines_rate_dropped_total', (SELECT count(*) FROM log_staged WHERE NOT admitted)",
        "SELECT 5, 3, '', 'compression_raw_bytes_total', (SELECT CAST(sum(strlen(line)) AS BIGINT) FROM log_written)",
        "SELECT 6, 3, '', 'compression_packed_bytes_total', (SELECT packed FROM packing)",
        "SELECT 7, 2, '{trigger=\"' || trigger || '\"}', 'output_rotations_total', n FROM rotations",
        "SELECT 12, 3, '', 'replay_index_hits_total', (SELECT count(*) FILTER (WHERE positioned_by = 'index') FROM positions)",
        "SELECT 13, 3, '', 'replay_index_fallbacks_total', (SELECT count(*) FILTER (WHERE positioned_by = 'fallback') FROM positions)",
        "SELECT 14, 3, '', 'replay_skipped_bytes_total', (SELECT CAST(sum(skipped_bytes) AS BIGINT) FROM passed)",
        "SELECT 8, 3, '', 'kv_lines_attempted_total', (SELECT count(*) FROM log_limited WHERE admitted)",
        "SELECT 9, 3, '', 'kv_lines_extracted_total', (SELECT count(DISTINCT line_id) FROM log_kv)",
        "SELECT 10, 3, '', 'kv_fields_extracted_total', (SELECT count(*) FROM log_kv)",
        "SELECT 11, 3, '', 'kv_extraction_ratio', (SELECT (x.e * 100 + x.a // 2) // x.a FROM (SELECT (SELECT count(DISTINCT line_id) FROM log_kv) AS e, (SELECT count(*) FROM log_limited WHERE admitted) AS a) x)",
        "SELECT 15, 2, '{source=\"' || source || '\"}', 'source_lines_total', count(*) FROM log_limited WHERE admitted GROUP BY source",
        "SELECT 16, 2, '{source=\"' || s.source || '\"}', 'source_output_bytes_total', CAST(coalesce(sum(strlen(w.line) + 1), 0) AS BIGINT) FROM (SELECT DISTINCT source FROM log_limited WHERE admitted) s LEFT JOIN log_written w ON w.source = s.source GROUP BY s.source",
        "SELECT 17, 2, '{output=\"' || output || '\"}', 'output_lines_written_total', count(*) FROM log_written GROUP BY output",
        "SELECT 18, 2, '{output=\"' || output || '\"}', 'output_bytes_written_total', CAST(sum(strlen(line) + 1) AS BIGINT) FROM log_written GROUP BY output",
        "SELECT 19, 2, '{type=\"' || source_type || '\"}', 'source_type_lines_total', count(*) FROM log_lines GROUP BY source_type",
        "SELECT 20, 2, '{type=\"' || source_type || '\"}', 'source_type_active', count(DISTINCT source) FROM log_lines GROUP BY source_type",
        "SELECT 21, 2, '{key=\"' || key || '\",value=\"' || value || '\"}', 'field_value_count', cnt FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cnt DESC, value) AS rk FROM (SELECT key, value, count(*) AS cnt FROM log_kv GROUP BY key, value) c) t WHERE rk <= 10",
    ]
)
_HEADS = ", ".join(f"({i}, '{n}', '{t}', '{h}')" for i, (n, t, h) in enumerate(ops.FAMILIES))


@query(
    "prometheus_lines",
    f"""SELECT * FROM (WITH lv AS (SELECT n.level, count(r.line_id) AS lines
        FROM (VALUES ('DEBUG',0),('INFO',1),('WARN',2),('ERROR',3),('RAW',4)) n(level, severity)
        LEFT JOIN log_records r ON least(r.severity, 4) = n.severity GROUP BY n.level),
      ch AS (SELECT source, line_no, output, unnest(string_split(line, '')) AS c, unnest(range(strlen(line))) AS i FROM log_written),
      g AS (SELECT *, i - row_number() OVER (PARTITION BY source, line_no, output, c ORDER BY i) AS isl FROM ch),
      runs AS (SELECT source, line_no, output, c, isl, count(*) AS n, min(i) AS i0 FROM g GROUP BY ALL),
      lit AS (SELECT source, line_no, output, i0 - row_number() OVER (PARTITION BY source, line_no, output ORDER BY i0) AS seg FROM runs WHERE n = 1),
      seg AS (SELECT source, line_no, output, seg, count(*) AS n FROM lit GROUP BY ALL),
      packing AS (SELECT CAST((SELECT count(*) * 16 FROM log_written) + (SELECT sum(n + ceil(n / 128.0)) FROM seg)
        + (SELECT count(*) * 2 FROM runs WHERE n > 1) AS BIGINT) AS packed),
      plan AS ({_ROTATION}),
      by_day AS (SELECT output, day, max(file_no) AS files FROM plan GROUP BY output, day),
      rotations AS (SELECT 'size' AS trigger, CAST(sum(files) AS BIGINT) AS n FROM by_day
        UNION ALL SELECT 'day', CAST(count(*) - count(DISTINCT output) AS BIGINT) FROM by_day),
      positions AS ({_POSITIONS}), passed AS ({_SKIPPED}),
      samples AS ({_PROM}),
      heads AS (SELECT * FROM (VALUES {_HEADS}) h(family_no, fam, typ, help))
      SELECT CAST(family_no AS INTEGER) AS family_no, kind, label, 'opslens_' || fam || label || ' ' || v AS text FROM samples
      UNION ALL SELECT family_no, 0, '', '# HELP opslens_' || fam || ' ' || help FROM heads WHERE fam IN (SELECT fam FROM samples)
      UNION ALL SELECT family_no, 1, '', '# TYPE opslens_' || fam || ' ' || typ FROM heads WHERE fam IN (SELECT fam FROM samples)) z""",
)
def _(spark, sf):
    lines = views.log_lines(spark, sf)
    offsets = ops.line_offsets(lines, 1 << 16)
    positions = ops.replay_positioning(offsets, ops.build_line_index(offsets, 4096), SINCE_MS)
    more = [ops.rotation_facts(_plan(spark, sf, 1 << 16)), ops.replay_facts(positions, ops.replay_skipped_bytes(lines, SINCE_MS))]
    return ops.prometheus_lines(flow(spark, sf), ROUTES, more=more)


@query(
    "compression_report",
    f"""SELECT * FROM (
      WITH w AS (SELECT source, line_no, ts_text || ' [' || level || '] [' || source || '] ' || message AS body FROM log_records),
      lines AS (SELECT source, line_no, body || ' |crc=' || lpad(upper(to_hex({crc32('body')})), 8, '0') AS line FROM w),
      ch AS (SELECT source, line_no, unnest(string_split(line, '')) AS c, unnest(range(strlen(line))) AS i FROM lines),
      g AS (SELECT *, i - row_number() OVER (PARTITION BY source, line_no, c ORDER BY i) AS isl FROM ch),
      runs AS (SELECT source, line_no, c, isl, count(*) AS n, min(i) AS i0 FROM g GROUP BY ALL),
      lit AS (SELECT source, line_no, i0 - row_number() OVER (PARTITION BY source, line_no ORDER BY i0) AS seg FROM runs WHERE n = 1),
      seg AS (SELECT source, line_no, seg, count(*) AS n FROM lit GROUP BY ALL),
      cost AS (SELECT source, sum(n + ceil(n / 128.0)) AS c FROM seg GROUP BY source),
      rep AS (SELECT source, count(*) * 2 AS c FROM runs WHERE n > 1 GROUP BY source),
      tot AS (SELECT source, sum(strlen(line)) AS raw, count(*) * 16 AS fixed FROM lines GROUP BY source)
      SELECT replace(replace(t.source, 'logs/', ''), '.', '_') AS output, CAST(raw AS BIGINT) AS raw_bytes,
        CAST(fixed + cost.c + rep.c AS BIGINT) AS packed_bytes,
        CAST(fixed + cost.c + rep.c AS BIGINT) * 100 // CAST(raw AS BIGINT) AS percent
      FROM tot t JOIN cost ON cost.source = t.source JOIN rep ON rep.source = t.source) z""",
)
def _(spark, sf):
    return ops.compression_report(_written(spark, sf))


@query(
    "run_length_rows",
    """SELECT source, f AS first, l AS last, parsed, n FROM (
      SELECT source, parsed, min(line_no) AS f, max(line_no) AS l, count(*) AS n FROM (
        SELECT source, line_no, parsed, line_no - row_number() OVER (PARTITION BY source, parsed ORDER BY line_no) AS isl FROM log_records) g
      GROUP BY source, parsed, isl) z""",
)
def _(spark, sf):
    return ops.run_length_rows(records(spark, sf), ["source"], "line_no", "parsed", 1 << 16)


# --- output lines -----------------------------------------------------------------


@query(
    "format_text_line",
    f"""SELECT line_id, body || ' |crc=' || lpad(upper(to_hex({crc32('body')})), 8, '0') AS line FROM (
      SELECT line_id, ts_text || ' [' || level || '] [' || source || '] ' || message AS body FROM log_records) x""",
)
def _(spark, sf):
    line = L.text_line(F.col("ts_text"), F.col("level"), F.col("source"), F.col("message"))
    return records(spark, sf).select("line_id", line.alias("line"))


@query(
    "format_json_line",
    f"""SELECT line_id, body || ',"crc":' || {crc32('body')} || '}}' AS line FROM (
      SELECT line_id, '{{"ts":"' || ts_text || '","level":"' || level || '","source":"' || source || '","message":"'
        || replace(message, '"', '\\"') || '"' AS body FROM log_records) x""",
)
def _(spark, sf):
    line = L.json_line(F.col("ts_text"), F.col("level"), F.col("source"), F.col("message"))
    return records(spark, sf).select("line_id", line.alias("line"))


def _damaged(line, key):
    return (
        F.when(key % 50 == 1, F.lit("#log v1.0.0 text created=2026-01-01T00:00:00Z"))
        .when(key % 50 == 2, F.replace(line, F.lit("e"), F.lit("E")))
        .when(key % 50 == 3, F.substring(line, F.lit(1), F.length(line) - 1))
        .otherwise(line)
    )


_VERDICTS = """SELECT verdict, count(*) AS lines FROM (SELECT CASE WHEN line_id % 50 = 1 THEN 'header'
  WHEN line_id % 50 = 3 THEN 'bad_shape' WHEN line_id % 50 = 2 AND strpos(%s, 'e') > 0 THEN '%s' ELSE 'ok' END AS verdict
  FROM log_records) x GROUP BY verdict"""


@query("verify_text_lines", _VERDICTS.replace("%s", "message || source || level", 1).replace("%s", "bad_crc") )
def _(spark, sf):
    line = L.text_line(F.col("ts_text"), F.col("level"), F.col("source"), F.col("message"))
    damaged = records(spark, sf).select(_damaged(line, F.col("line_id")).alias("line"))
    return damaged.groupBy(L.text_line_verdict(F.col("line")).alias("verdict")).agg(F.count(F.lit(1)).alias("lines"))


@query("verify_json_lines", _VERDICTS.replace("%s", "'e'", 1).replace("%s", "bad_shape"))
def _(spark, sf):
    line = L.json_line(F.col("ts_text"), F.col("level"), F.col("source"), F.col("message"))
    damaged = records(spark, sf).select(_damaged(line, F.col("line_id")).alias("line"))
    return damaged.groupBy(L.json_line_verdict(F.col("line")).alias("verdict")).agg(F.count(F.lit(1)).alias("lines"))


# --- settings, times ----------------------------------------------------------------


@query(
    "overlay_merge",
    """SELECT app, key, value, layer, renamed FROM (
      WITH s AS (SELECT 'app' || (user_id % 50) AS app, event_id AS seq, event_type || '-' || event_id AS value, event_id % 5 % 3 AS rk,
          ['file','profile','env'][CAST(event_id % 5 % 3 + 1 AS BIGINT)] AS layer,
          ['input.files','input.files','rotate.daily','rotate.daily','extract.kv','extract.kv','output.format','output.format',
           'rate.max_lines_per_sec','rate.max_lines_per_sec','run.stop_file','level'][CAST(event_id % 12 + 1 AS BIGINT)] AS key,
          event_id % 12 IN (0, 2, 4, 6, 8, 10) AS renamed
        FROM events WHERE NOT (event_id % 5 % 3 = 1 AND event_id % 2 <> 0))
      SELECT *, row_number() OVER (PARTITION BY app, key ORDER BY rk DESC, seq DESC) AS rn FROM s) z WHERE rn = 1""",
)
def _(spark, sf):
    return ops.overlay_merge(views.settings(spark, sf), "prod")


@query(
    "inline_timestamp",
    f"SELECT line_id, {_IN_LINE} AS at_ms, CAST({_IN_LINE} + 250 AS BIGINT) AS setting_ms FROM log_lines",
)
def _(spark, sf):
    stamp = F.concat(F.substring("text", 1, 19), F.lit(".25"))
    return views.log_lines(spark, sf).select(
        "line_id", T.in_line_ms(F.col("text")).alias("at_ms"), T.setting_ms(stamp).alias("setting_ms")
    )


@query(
    "time_formats",
    """SELECT line_id, strftime(ingested_ts, '%Y-%m-%d %H:%M:%S.%g') AS clock, strftime(ingested_ts, '%Y%m%d_%H%M%S') AS compact,
      strftime(ingested_ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM log_lines""",
)
def _(spark, sf):
    ts = F.col("ingested_ts").cast("timestamp")
    return views.log_lines(spark, sf).select(
        "line_id",
        T.clock_ms(F.unix_millis(ts)).alias("clock"),
        T.compact_stamp(ts).alias("compact"),
        T.utc_stamp(ts).alias("utc"),
    )


@query(
    "format_duration",
    """SELECT line_id, CASE WHEN ts_ms < 1000 THEN ts_ms || 'ms' WHEN ts_ms < 60000 THEN (ts_ms // 1000) || '.' || (ts_ms % 1000 // 100) || 's'
      ELSE (ts_ms // 60000) || 'm' || lpad(CAST(ts_ms // 1000 % 60 AS VARCHAR), 2, '0') || 's' END AS shown FROM log_lines""",
)
def _(spark, sf):
    return views.log_lines(spark, sf).select("line_id", T.format_duration(F.col("ts_ms")).alias("shown"))


@query(
    "json_parse_props",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)
def _(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).alias("k")
    )


@query(
    "dedupe_inputs",
    "SELECT DISTINCT source AS path FROM log_lines",
)
def _(spark, sf):
    e = F.col("line_id")
    written = F.when(e % 4 == 0, F.concat(F.lit("./"), F.col("source"))).when(
        e % 4 == 1, F.replace("source", F.lit("/"), F.lit("//"))
    ).when(e % 4 == 2, F.replace("source", F.lit("/"), F.lit("/x/../"))).otherwise(F.col("source"))
    return readers.distinct_paths(views.log_lines(spark, sf).select(written.alias("path")))


@query(
    "write_per_source",
    "SELECT replace(replace(source, 'logs/', ''), '.', '_') AS name, count(*) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM log_lines GROUP BY 1",
)
def _(spark, sf):
    out = fresh_dir(spark, "write_per_source")
    sinks.write_per_source(views.log_lines(spark, sf), F.col("text"), out)
    return spark.read.text(out).groupBy("name").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(T.utf8_bytes(F.col("value"))).alias("bytes")
    )


@query(
    "write_daily",
    "SELECT strftime(ingested_ts, '%Y-%m-%d') AS dt, count(*) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM log_lines GROUP BY 1",
)
def _(spark, sf):
    out = fresh_dir(spark, "write_daily")
    sinks.write_daily(views.log_lines(spark, sf), F.col("text"), F.col("ingested_ts"), out)
    written = spark.read.schema("value string, dt string").text(out)
    return written.groupBy("dt").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(T.utf8_bytes(F.col("value"))).alias("bytes")
    )


@query(
    "read_log_lines",
    """SELECT replace(replace(source, 'logs/', ''), '.', '_') AS name, count(*) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
      true AS dense FROM log_lines GROUP BY 1""",
)
def _(spark, sf):
    out = fresh_dir(spark, "read_log_lines")
    sinks.write_per_source(views.log_lines(spark, sf), F.col("text"), out)
    per_file = (
        readers.read_log_lines(spark, out)
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("line_no").alias("top"),
            F.sum("line_no").alias("total"),
            F.sum(T.utf8_bytes(F.col("text"))).alias("bytes"),
        )
    )
    dense = (F.col("top") == F.col("n")) & (F.col("total") * 2 == F.col("n") * (F.col("n") + 1))
    return per_file.groupBy(F.regexp_extract("source", "/name=([^/]+)/", 1).alias("name")).agg(
        F.sum("n").alias("lines"), F.sum("bytes").alias("bytes"), F.every(dense).alias("dense")
    )


@query(
    "glob_select",
    """SELECT url FROM pages WHERE regexp_matches(url, '/[^/]*[0-9][^/]*$') AND NOT regexp_matches(url, '/[^/]*7[^/]*$')
      AND NOT regexp_matches(url, '^https://[^?]*/p/1') """,
)
def _(spark, sf):
    keep = F.lit(False)
    for digit in "0123456789":
        keep = keep | T.glob_match(F.col("url"), f"*{digit}*", ["*7*", "https://*/p/1*"])
    return views.table(spark, sf, "pages").where(keep).select("url")
