"""Task result logs and traces: parsing, status statistics, attempts, latency."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.text import dash_if_blank
from opslens.operators import ordered as O
from opslens.operators.staging import once

# Statuses a result line may carry, priorities and trace events.
STATUSES = ["OK", "FAILED", "RETRYING", "CANCELLED"]
PRIORITIES = {"Low": 0, "Normal": 1, "High": 2, "Critical": 3}
TRACE_EVENTS = [
    "enqueue", "dequeue", "start", "finish", "retry_requeue", "periodic_requeue", "cancel", "reject",
]


# --- parsing ----------------------------------------------------------------------


def _head(text: Column) -> Column:
    """Tokens before the first one that starts with ``detail=``."""
    before = F.regexp_replace(text, r"(?s)(\A|\s)detail=.*\z", "")
    return F.filter(F.split(before, r"\s+"), lambda t: t != "")


def _first(tokens: Column, name: str, shape: str | None = None) -> Column:
    """Value of the first ``name=`` token, or the first whose value has a shape."""
    prefix = f"{name}="
    if shape is None:
        wanted = F.filter(tokens, lambda t: t.startswith(prefix))
    else:
        wanted = F.filter(tokens, lambda t: t.rlike(rf"\A{name}={shape}\z"))
    return F.substring(F.get(wanted, F.lit(0)), F.lit(len(prefix) + 1), F.lit(1 << 30))


def ms_text_to_us(text: Column) -> Column:
    """``12.5`` milliseconds as 12500 microseconds; null unless ``digits[.1-3 digits]``."""
    whole = F.regexp_extract(text, r"\A(\d{1,15})(?:\.(\d{1,3}))?\z", 1)
    part = F.regexp_extract(text, r"\A(\d{1,15})(?:\.(\d{1,3}))?\z", 2)
    return F.when(whole != "", whole.cast("bigint") * 1000 + F.rpad(part, 3, "0").cast("bigint"))


def result_fields(tokens: Column) -> dict[str, Column]:
    """``status, tag, worker, duration_us`` of a result line's head; both historical
    layouts."""
    micros = _first(tokens, "duration_us", r"\d{1,18}").cast("bigint")
    millis = ms_text_to_us(_first(tokens, "duration_ms", r"\d{1,15}(\.\d{1,3})?"))
    return {
        "status": _first(tokens, "status"),
        "tag": dash_if_blank(_first(tokens, "tag")),
        "worker": _first(tokens, "worker", r"\d{1,9}").cast("int"),
        "duration_us": F.coalesce(micros, millis),
    }


def task_number(digits: Column) -> Column:
    """Unsigned 64-bit id as ``decimal(20, 0)``; null for no digits or a larger number."""
    number = F.nullif(digits, F.lit("")).try_cast("decimal(20, 0)")
    return F.when(number <= F.lit(Decimal(2**64 - 1)), number)


def parse_task_result(lines: DataFrame) -> DataFrame:
    """Add ``ts, task_id, status, tag, worker, duration_us, detail, class`` to ``text``.

    ``class`` is ``parsed``, ``skipped`` (no or unknown status) or ``blank``.
    """
    # Split once: the tokens are a column of their own, read by every field.
    split = once(lines, __head=_head(F.col("text")))
    parsed = split.withColumns(result_fields(F.col("__head"))).drop("__head")
    known = F.col("status").isin(*STATUSES)
    return parsed.withColumns(
        {
            "ts": F.try_to_timestamp(F.substring("text", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")),
            "task_id": F.regexp_extract("text", r"(?:^|\s)task_id=(\d{1,20})(?=\s|\z)", 1),
            "detail": F.regexp_extract("text", r"(?:^|\s)detail=([\s\S]*)\z", 1),
            "class": F.when(F.col("text") == "", "blank")
            .when(F.coalesce(known, F.lit(False)), "parsed")
            .otherwise("skipped"),
        }
    ).withColumn("task_id", task_number(F.col("task_id")))


def classify_result_lines(results: DataFrame) -> DataFrame:
    """``lines_total`` counts non-blank lines."""
    kind = F.col("class")
    return results.agg(
        F.count_if(kind != "blank").alias("lines_total"),
        F.count_if(kind == "parsed").alias("lines_parsed"),
        F.count_if(kind == "skipped").alias("lines_skipped"),
        F.count_if(kind == "blank").alias("lines_blank"),
    )


def parse_trace_line(lines: DataFrame) -> DataFrame:
    """``at_ms, event, task_id, fields`` of ``<ts.mmm> [trace] <event> task=<id> k=v``;
    other lines are dropped."""
    from opslens.functions.logline import kv_strict

    text = F.col("text")
    # The stamp and the marker have fixed widths: "yyyy-MM-dd HH:mm:ss.SSS [trace] ".
    body = F.substring(text, F.lit(33), F.length(text))
    task = F.regexp_extract(body, r"\A\w+ task=(\d{1,20})(?=\s|\z)", 1)
    rows = once(
        lines.where(F.substring(text, 24, 9) == " [trace] "),
        at_ms=F.unix_millis(F.try_to_timestamp(F.substring(text, 1, 23), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))),
        event=F.substring_index(body, " ", 1),
        __task=task,
    )
    known = F.col("event").isin(*TRACE_EVENTS) & task_number(F.col("__task")).isNotNull() & F.col("at_ms").isNotNull()
    others = [c for c in lines.columns if c not in ("text", "task_id")]
    return rows.where(known).select(
        *others,
        "at_ms",
        "event",
        task_number(F.col("__task")).alias("task_id"),
        kv_strict(F.substring(body, F.length("event") + 2, F.length(text))).alias("fields"),
    )


# --- status statistics ----------------------------------------------------------


def _counts() -> list[Column]:
    status = F.col("status")
    return [
        *[F.count_if(status == s).alias(s.lower()) for s in STATUSES],
        F.count(F.lit(1)).alias("total"),
    ]


def accepted(results: DataFrame) -> DataFrame:
    return results.where(F.col("class") == "parsed")


def tag_status_stats(results: DataFrame) -> DataFrame:
    return accepted(results).groupBy("tag").agg(*_counts())


def worker_status_stats(results: DataFrame) -> DataFrame:
    return accepted(results).where(F.col("worker").isNotNull()).groupBy("worker").agg(*_counts())


def tag_stats_total(results: DataFrame) -> DataFrame:
    """Tag rows, worker rows and one TOTAL row per block, from one pass."""
    rows = accepted(results).groupingSets(
        [["tag"], ["worker"], []], "tag", "worker"
    ).agg(
        *_counts(),
        F.grouping("tag").alias("no_tag"),
        F.grouping("worker").alias("no_worker"),
        *[F.count_if((F.col("status") == s) & F.col("worker").isNotNull()).alias(f"w_{s.lower()}") for s in STATUSES],
        F.count_if(F.col("worker").isNotNull()).alias("w_total"),
    )
    names = [s.lower() for s in STATUSES] + ["total"]
    tags = rows.where((F.col("no_tag") == 0)).select(F.lit("tag").alias("block"), F.col("tag").alias("name"), *names)
    workers = rows.where((F.col("no_worker") == 0) & F.col("worker").isNotNull()).select(
        F.lit("worker").alias("block"), F.col("worker").cast("string").alias("name"), *names
    )
    # Summing the one grand row keeps the TOTAL rows, as zeros, for an empty log.
    whole = rows.where((F.col("no_tag") == 1) & (F.col("no_worker") == 1)).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for n in names for c in (n, f"w_{n}")]
    )
    total = whole.select(F.lit("tag").alias("block"), F.lit("TOTAL").alias("name"), *names)
    worker_total = whole.select(
        F.lit("worker").alias("block"), F.lit("TOTAL").alias("name"), *[F.col(f"w_{n}").alias(n) for n in names]
    )
    return tags.unionByName(total).unionByName(workers).unionByName(worker_total)


def tag_p95(results: DataFrame) -> DataFrame:
    """Nearest-rank 95th percentile of the duration per tag, in microseconds; tags
    without durations have no row."""
    return O.nearest_rank(accepted(results), ["tag"], "duration_us", 95, "p95_us")


def task_metrics(results: DataFrame, priority: Column) -> DataFrame:
    """Executed, failed, retried, cancelled, average attempt time in ms and successes
    per priority, zero rows included."""
    status = F.col("status")
    ran = status.isin("OK", "FAILED", "RETRYING")
    return (
        accepted(results)
        .withColumn("priority", priority)
        .agg(
            F.count_if(status == "OK").alias("executed"),
            F.count_if(status == "FAILED").alias("failed"),
            F.count_if(status == "RETRYING").alias("retried"),
            F.count_if(status == "CANCELLED").alias("cancelled"),
            F.coalesce(
                F.sum(F.when(ran, F.coalesce("duration_us", F.lit(0)))) / 1000 / F.nullif(F.count_if(ran), F.lit(0)),
                F.lit(0.0),
            ).alias("average_ms"),
            *[
                F.count_if((status == "OK") & (F.col("priority") == rank)).alias(f"ok_{name.lower()}")
                for name, rank in PRIORITIES.items()
            ],
        )
    )


def attempts_per_task(results: DataFrame) -> DataFrame:
    """Attempts, retries, last status and the highest ``attempt k of n`` per task.

    Needs ``seq``, the order of a task's lines.
    """
    attempt = r"^attempt (\d{1,9}) of (\d{1,9})"
    number = F.regexp_extract("detail", attempt, 1)
    allowed = F.regexp_extract("detail", attempt, 2)
    return (
        accepted(results)
        .groupBy("task_id")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count_if(F.col("status") == "RETRYING").alias("retries"),
            F.max_by("status", "seq").alias("last_status"),
            F.max(F.nullif(number, F.lit("")).cast("bigint")).alias("last_attempt"),
            F.max(F.nullif(allowed, F.lit("")).cast("bigint")).alias("allowed"),
        )
    )


def dead_letters(results: DataFrame) -> DataFrame:
    """Finally failed attempts in order of occurrence."""
    return accepted(results).where(F.col("status") == "FAILED").select("seq", "task_id", "detail").orderBy("seq")


# --- traces -------------------------------------------------------------------------


def dispatch_order(queue: DataFrame, keys: Sequence[str], chunk: int = O.CHUNK_ROWS) -> DataFrame:
    """Position at which each waiting task runs: priority first, then ``seq``."""
    cut = F.struct(-F.col("priority"), O.chunk_of(F.col("seq"), chunk))
    ranked = queue.withColumns({"urgency": -F.col("priority"), "chunk": cut})
    return O.number_rows(ranked, keys, "chunk", ["urgency", "seq"], "position").drop("chunk", "urgency")


def task_latency(trace: DataFrame, chunk: int | None = None) -> DataFrame:
    """Per task and attempt: queue wait, run time and, for retries, the retry gap.

    ``trace`` holds ``task_id, seq, at_ms, event``.  A task's lines are numbered and aggregated after
    one shuffle by task.  ``chunk`` is for traces in which a task runs for so long that its lines
    must not meet in one task: they are then cut into chunks of so many ``seq``.
    """
    requeue = F.when(F.col("event").isin("retry_requeue", "periodic_requeue"), 1).otherwise(0)
    lines = trace.select("task_id", "seq", "at_ms", "event")
    if chunk is None:
        upto = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = lines.withColumn("requeues", F.sum(requeue).over(upto))
    else:
        marked = lines.withColumn("chunk", O.chunk_of(F.col("seq"), chunk))
        numbered = O.running(marked, ["task_id"], "chunk", ["seq"], {"requeues": ("sum", requeue)})

    def first(*events: str) -> Column:
        return F.min(F.when(F.col("event").isin(*events), F.col("at_ms")))

    times = numbered.groupBy("task_id", (F.col("requeues") + 1).cast("bigint").alias("attempt")).agg(
        first("enqueue", "retry_requeue", "periodic_requeue").alias("queued"),
        first("retry_requeue").alias("retried"),
        first("dequeue").alias("taken"),
        first("start").alias("started"),
        first("finish").alias("finished"),
    )
    return times.select(
        "task_id",
        "attempt",
        (F.col("taken") - F.col("queued")).alias("queue_wait_ms"),
        (F.col("finished") - F.col("started")).alias("run_ms"),
        (F.col("taken") - F.col("retried")).alias("retry_gap_ms"),
    )


def cancel_resolution(trace: DataFrame, requests: DataFrame, bucket: int = 60_000) -> DataFrame:
    """Whether each cancel request ``(task_id, request_id, at_ms)`` finds its task queued.

    The last queue event at or before the request decides; a request succeeds
    only once per stay in the queue.
    """
    queue = trace.where(
        F.col("event").isin("enqueue", "retry_requeue", "periodic_requeue", "dequeue", "cancel")
    ).withColumn("entered", F.struct("event", "at_ms"))
    seen = O.asof_last(
        queue, requests, ["task_id"], "at_ms", "entered", "state", bucket, tiebreak="seq"
    )
    queued = F.col("state.event").isin("enqueue", "retry_requeue", "periodic_requeue")
    judged = seen.withColumn("queued", F.coalesce(queued, F.lit(False))).withColumn(
        "since", F.col("state.at_ms")
    )
    first = (
        judged.where("queued")
        .groupBy("task_id", "since")
        .agg(F.min(F.struct("at_ms", "request_id")).alias("first"))
    )
    return (
        judged.join(first, ["task_id", "since"], "left")
        .withColumn(
            "cancelled",
            F.col("queued")
            & F.coalesce(F.col("first") == F.struct("at_ms", "request_id"), F.lit(False)),
        )
        .select("task_id", "request_id", "at_ms", "cancelled")
    )


def surviving_queue(trace: DataFrame, resolved: DataFrame) -> DataFrame:
    """Tasks whose last event leaves them queued and which no request cancelled."""
    last = trace.groupBy("task_id").agg(F.max_by("event", "seq").alias("event"))
    waiting = last.where(F.col("event").isin("enqueue", "retry_requeue", "periodic_requeue")).select("task_id")
    return waiting.join(resolved.where("cancelled"), "task_id", "left_anti")


# --- report texts -----------------------------------------------------------------


def task_result_text(row: dict[str, Column]) -> Column:
    """Canonical result line; blank texts and negative numbers become ``-``."""
    number = lambda c: F.coalesce(F.when(c >= 0, c.cast("string")), F.lit("-"))
    return F.concat(
        F.date_format(row["ts"], "yyyy-MM-dd HH:mm:ss"),
        F.lit(" task_id="), row["task_id"].cast("string"),
        F.lit(" status="), row["status"],
        F.lit(" tag="), dash_if_blank(row["tag"]),
        F.lit(" type="), dash_if_blank(row["type"]),
        F.lit(" worker="), number(row["worker"]),
        F.lit(" duration_us="), number(row["duration_us"]),
        F.lit(" detail="), dash_if_blank(row["detail"]),
    )


def ms_to_us(ms: Column) -> Column:
    """Milliseconds to whole microseconds, half up; negative means not executed (-1)."""
    return F.when(ms < 0, F.lit(-1).cast("bigint")).otherwise(F.floor(ms * 1000 + 0.5).cast("bigint"))


def ms_text(us: Column) -> Column:
    """Microseconds as milliseconds with three decimals."""
    return F.concat(F.floor(us / 1000).cast("string"), F.lit("."), F.lpad((us % 1000).cast("string"), 3, "0"))


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def _report_rows(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Block rows with p95 and the line counts."""
    blocks = tag_stats_total(results)
    p95 = tag_p95(results).select(F.lit("tag").alias("block"), F.col("tag").alias("name"), "p95_us")
    total = F.col("name") == "TOTAL"
    rows = blocks.withColumn("is_total", total).join(p95, ["block", "name"], "left")
    return rows, classify_result_lines(results)


def export_tag_stats_csv(results: DataFrame, log_file: str, found: bool = True) -> DataFrame:
    """CSV report as ``section, place, text`` lines in output order.

    Lines rather than one string: the number of tags is not bounded.
    """
    rows, counts = _report_rows(results)
    names = [s.lower() for s in STATUSES] + ["total"]
    cells = F.concat_ws(",", csv_field(F.col("name")), *[F.col(n).cast("string") for n in names])
    p95 = F.coalesce(F.when(~F.col("is_total"), ms_text(F.col("p95_us"))), F.lit(""))
    section = F.when(F.col("block") == "tag", 2).otherwise(5) + F.col("is_total").cast("int")
    body = rows.select(
        section.alias("section"),
        F.when(F.col("block") == "worker", F.lpad("name", 12, "0")).otherwise(F.col("name")).alias("place"),
        F.when(F.col("block") == "tag", F.concat(cells, F.lit(","), p95)).otherwise(cells).alias("text"),
    )
    meta = [
        ("0", F.concat(F.lit("log_file,"), csv_field(F.lit(log_file)))),
        ("1", F.lit(f"file_found,{'true' if found else 'false'}")),
        ("2", F.concat(F.lit("lines_total,"), F.col("lines_total").cast("string"))),
        ("3", F.concat(F.lit("lines_parsed,"), F.col("lines_parsed").cast("string"))),
        ("4", F.concat(F.lit("lines_skipped,"), F.col("lines_skipped").cast("string"))),
    ]
    heads = [(1, "tag," + ",".join(names) + ",p95_duration_ms"), (4, "worker," + ",".join(names))]
    fixed = [F.struct(F.lit(0).alias("section"), F.lit(p).alias("place"), t.alias("text")) for p, t in meta]
    fixed += [F.struct(F.lit(s).alias("section"), F.lit("").alias("place"), F.lit(t).alias("text")) for s, t in heads]
    return counts.select(F.inline(F.array(*fixed))).unionByName(body).orderBy("section", "place")


def export_tag_stats_json(results: DataFrame, log_file: str, found: bool = True) -> DataFrame:
    """JSON report as ``section, place, text`` lines; their texts joined by newlines
    are one document."""
    rows, counts = _report_rows(results)
    names = [s.lower() for s in STATUSES] + ["total"]
    numbers = F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), F.col(n).cast("string")) for n in names])
    # Spark escapes exactly the characters a JSON string needs.
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("name").alias("v"))), r'\A\{"v":([\s\S]*)\}\z', 1)
    p95 = F.coalesce(ms_text(F.col("p95_us")), F.lit("null"))
    place = F.when(F.col("block") == "worker", F.lpad("name", 12, "0")).otherwise(F.col("name"))
    entry = F.when(
        F.col("block") == "tag",
        F.concat(F.lit('{"tag": '), quoted, F.lit(", "), numbers, F.lit(', "p95_duration_ms": '), p95, F.lit("}")),
    ).otherwise(F.concat(F.lit('{"worker": '), F.col("name"), F.lit(", "), numbers, F.lit("}")))
    last = rows.where(~F.col("is_total")).groupBy("block").agg(F.max(place).alias("last"))
    listed = (
        rows.where(~F.col("is_total"))
        .join(last, "block")
        .select(
            F.when(F.col("block") == "tag", 2).otherwise(4).alias("section"),
            place.alias("place"),
            F.concat(F.lit("    "), entry, F.when(place == F.col("last"), "").otherwise(",")).alias("text"),
        )
    )
    total = rows.where(F.col("is_total") & (F.col("block") == "tag")).select(
        F.lit(6).alias("section"), F.lit("").alias("place"),
        F.concat(F.lit('  "total": {'), numbers, F.lit("}")).alias("text"),
    )

    def line(section: int, place: str, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(place).alias("place"), text.alias("text"))

    file_name = F.regexp_extract(F.to_json(F.struct(F.lit(log_file).alias("v"))), r'\A\{"v":([\s\S]*)\}\z', 1)
    frame = [
        line(0, "0", F.lit("{")),
        line(0, "1", F.concat(F.lit('  "log_file": '), file_name, F.lit(","))),
        line(0, "2", F.lit(f'  "file_found": {"true" if found else "false"},')),
        line(0, "3", F.concat(F.lit('  "lines_total": '), F.col("lines_total").cast("string"), F.lit(","))),
        line(0, "4", F.concat(F.lit('  "lines_parsed": '), F.col("lines_parsed").cast("string"), F.lit(","))),
        line(0, "5", F.concat(F.lit('  "lines_skipped": '), F.col("lines_skipped").cast("string"), F.lit(","))),
        line(1, "", F.lit('  "tags": [')),
        line(3, "0", F.lit("  ],")),
        line(3, "1", F.lit('  "workers": [')),
        line(5, "", F.lit("  ],")),
        line(7, "", F.lit("}")),
    ]
    return (
        counts.select(F.inline(F.array(*frame))).unionByName(listed).unionByName(total).orderBy("section", "place")
    )
