"""DuckDB definitions of the derived tables and a helper that prefixes the ones a
query names.  Written on their own terms, not from the Spark expressions."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["log_lines"] = """
SELECT event_id AS line_id,
  CASE WHEN event_id % 3 = 0 THEN 'logs/app_0.log'
       ELSE 'logs/app_' || CAST(((event_id // 3) * 2 + event_id % 3 - 1) % 4 + 1 AS VARCHAR) || '.log' END AS source,
  CASE WHEN event_id % 3 <> 0 AND ((event_id // 3) * 2 + event_id % 3 - 1) % 4 = 3 THEN 'glob' ELSE 'file' END AS source_type,
  CASE WHEN event_id % 3 = 0 THEN event_id // 3 ELSE ((event_id // 3) * 2 + event_id % 3 - 1) // 4 END + 1 AS line_no,
  event_id * 137 AS ts_ms, ts AS ingested_ts, user_id, event_type,
  CASE WHEN event_id % 17 = 0 THEN 'noise' WHEN event_id % 23 = 0 THEN 'pure' ELSE 'plain' END AS shape,
  CASE WHEN event_id % 17 = 0 THEN 'plain unparsed noise ' || event_id
       WHEN event_id % 23 = 0 THEN 'job=sync status=done id=' || event_id
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ['
         || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'notice'
                            WHEN 'purchase' THEN 'Warning' ELSE 'AUDIT' END
         || '] evt user=u' || user_id || ' type=' || event_type
         || CASE WHEN event_id % 7 = 0 THEN ' note="took ' || CAST(event_id % 100 AS VARCHAR) || ' ms"' ELSE '' END
  END AS text
FROM events"""

# AUDIT is registered with severity 7.
VIEWS["log_records"] = """
SELECT *, shape = 'plain' AS parsed,
  CASE WHEN shape <> 'plain' THEN 4 WHEN event_type = 'error' THEN 3 WHEN event_type = 'view' THEN 0
       WHEN event_type = 'click' THEN 1 WHEN event_type = 'purchase' THEN 2 ELSE 7 END AS severity,
  CASE WHEN shape <> 'plain' THEN 'RAW' WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'DEBUG'
       WHEN event_type = 'click' THEN 'NOTICE' WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'AUDIT' END AS level,
  CASE WHEN shape = 'plain' THEN strftime(ingested_ts, '%Y-%m-%d %H:%M:%S')
       ELSE strftime(ingested_ts, '%Y-%m-%d %H:%M:%S.%g') END AS ts_text,
  CASE WHEN shape = 'plain' THEN substr(text, strpos(text, '] ') + 2) ELSE text END AS message
FROM log_lines"""

VIEWS["log_limited"] = """
SELECT *, row_number() OVER (PARTITION BY source, ts_ms // 1000 ORDER BY ts_ms, line_no) <= 2 AS admitted
FROM log_records"""

VIEWS["log_kv"] = """
SELECT line_id, source, line_no, k AS key, v AS value FROM (
  SELECT line_id, source, line_no, unnest(['user','type','note']) AS k,
    unnest(['u' || user_id, event_type, regexp_extract(text, 'note="([^"]*)"', 1)]) AS v
  FROM log_limited WHERE admitted AND shape = 'plain'
  UNION ALL
  SELECT line_id, source, line_no, unnest(['job','status','id']), unnest(['sync','done', CAST(line_id AS VARCHAR)])
  FROM log_limited WHERE admitted AND shape = 'pure') x
WHERE k <> 'note' OR v <> ''"""

# Threshold INFO, keyword "e", records of type view dropped by the predicate.
VIEWS["log_staged"] = """
SELECT *, CASE WHEN NOT admitted THEN NULL
  WHEN shape = 'plain' AND event_type = 'view' THEN 'predicate'
  WHEN severity < 1 THEN 'level'
  WHEN strpos(lower(message), 'e') = 0 THEN 'keyword' END AS stage
FROM log_limited"""

VIEWS["log_routed"] = """
SELECT source, line_no, ingested_ts, 'warnings' AS output, ts_text, level, message, 'text' AS format
FROM log_staged WHERE admitted AND stage IS NULL AND severity >= 2
UNION ALL
SELECT source, line_no, ingested_ts, 'errors', ts_text, level, upper(message), 'json'
FROM log_staged WHERE admitted AND stage IS NULL AND severity >= 3
UNION ALL
SELECT source, line_no, ingested_ts, 'note', ts_text, level, replace(message, 'evt', 'EVENT'), 'text'
FROM log_staged WHERE admitted AND stage IS NULL AND shape = 'plain' AND line_id % 7 = 0
  AND strpos(message, 'took 4') > 0"""

# CRC-32 of ASCII text, byte by byte.
def _crc_entry(value: int) -> int:
    for _ in range(8):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


_CRC_TABLE = ", ".join(str(_crc_entry(n)) for n in range(256))


def crc32(body: str) -> str:
    """DuckDB expression for the CRC-32 of an ASCII string."""
    return (
        "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), "
        f"list_transform(string_split({body}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
        f"lambda c, b: xor(c >> 8, list_extract([{_CRC_TABLE}], CAST((xor(c, b) & 255) + 1 AS BIGINT)))))"
    )


VIEWS["log_written"] = f"""
SELECT source, line_no, ingested_ts, output, body, format,
  CASE WHEN format = 'text' THEN body || ' |crc=' || lpad(upper(to_hex(crc)), 8, '0')
       ELSE body || ',"crc":' || CAST(crc AS VARCHAR) || '}}' END AS line
FROM (SELECT *, {crc32('body')} AS crc FROM (
  SELECT *, CASE WHEN format = 'text' THEN ts_text || ' [' || level || '] [' || source || '] ' || message
    ELSE '{{"ts":"' || ts_text || '","level":"' || level || '","source":"' || source || '","message":"'
      || replace(message, '"', '\\"') || '"' END AS body FROM log_routed) a) b"""

VIEWS["task_lines"] = """
SELECT o_orderkey AS line_id,
  CASE WHEN o_orderkey % 29 = 0 THEN 'garbage ' || o_orderkey
  ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' task_id=' || o_orderkey || ' status=' ||
    CASE WHEN o_orderkey % 11 = 0 THEN 'CANCELLED' WHEN o_orderkey % 31 = 0 THEN 'BOGUS'
         WHEN o_orderstatus = 'O' THEN 'OK' WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'RETRYING' END
    || ' tag=' || CASE WHEN o_orderkey % 13 = 0 THEN '-' ELSE replace(o_orderpriority, ' ', '_') END
    || ' type=oneshot worker=' || CASE WHEN o_orderkey % 11 = 0 THEN '-' ELSE CAST(o_custkey % 8 AS VARCHAR) END
    || CASE WHEN o_orderkey % 11 = 0 THEN ' duration_us=-'
         WHEN o_orderkey % 5 = 0 THEN ' duration_ms=' || CAST(o_custkey % 900 AS VARCHAR) || '.5'
         ELSE ' duration_us=' || CAST(o_custkey * 37 % 1000003 AS VARCHAR) END
    || ' detail=attempt ' || CAST(o_orderkey % 3 + 1 AS VARCHAR) || ' of 3: tag=not_this_one' END AS text
FROM orders"""

# Task results straight from the columns the lines were made of.
VIEWS["task_rows"] = """
SELECT o_orderkey AS line_id, o_orderkey AS task_id, o_orderdate AS ts,
  CASE WHEN o_orderkey % 11 = 0 THEN 'CANCELLED' WHEN o_orderkey % 31 = 0 THEN 'BOGUS'
       WHEN o_orderstatus = 'O' THEN 'OK' WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'RETRYING' END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN '-' ELSE replace(o_orderpriority, ' ', '_') END AS tag,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 8 END AS worker,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_custkey % 900 * 1000 + 500
       ELSE o_custkey * 37 % 1000003 END AS duration_us,
  o_orderkey % 3 + 1 AS attempt, o_orderpriority
FROM orders WHERE o_orderkey % 29 <> 0"""
VIEWS["task_good"] = "SELECT * FROM task_rows WHERE status <> 'BOGUS'"

VIEWS["trace_rows"] = """
SELECT o_orderkey AS task_id, seq, ev AS event, 1700000000000 + o_orderkey * 10 + seq * (o_custkey % 97) AS at_ms,
  o_custkey, CASE WHEN seq > 4 THEN 2 WHEN o_orderkey % 5 = 0 AND seq = 5 THEN 2 ELSE 1 END AS attempt,
  CASE WHEN ev = 'finish' THEN CASE WHEN o_orderkey % 5 = 0 AND seq = 4 THEN 'RETRYING' ELSE 'OK' END END AS status
FROM orders, (VALUES (1,'enqueue'),(2,'dequeue'),(3,'start'),(4,'finish'),(5,'retry_requeue'),(6,'dequeue'),
  (7,'start'),(8,'finish')) s(seq, ev)
WHERE seq <= CASE WHEN o_orderkey % 19 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 8 ELSE 4 END"""


def sql(body: str) -> str:
    """``body`` with a WITH clause for every derived table it (indirectly) names."""
    ordered: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_][a-z0-9_]*", text):
            if word in VIEWS and word not in seen:
                seen.add(word)
                visit(VIEWS[word])
                ordered.append(word)

    visit(body)
    if not ordered:
        return body
    joined = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    return f"WITH RECURSIVE {joined}\n{body.strip()}"
