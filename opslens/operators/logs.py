"""Log line operators: parse, limit, enrich, filter, route, count, replay, index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from opslens.functions import logline as L
from opslens.functions import text as T
from opslens.operators import ordered as O
from opslens.operators.staging import once, small_table, stored

Record = dict[str, Column]


def parse_log_line(lines: DataFrame, custom: dict[str, int] | None = None) -> DataFrame:
    """Add ``parsed, severity, level, ts_text, message``."""
    return lines.withColumns(L.parse_columns(F.col("text"), F.col("ingested_ts"), custom))


def register_levels(requests: DataFrame) -> DataFrame:
    """Judge ``seq, name, value`` requests; ``error`` is null where accepted.

    The first valid request of a word wins; a later one is accepted only when it
    repeats the same value.
    """
    word = T.ascii_upper(F.col("name"))
    builtin = word.isin(*L.SEVERITIES, *L.ALIASES)
    judged = requests.withColumn("word", word).withColumn(
        "fault",
        F.when(T.strip_all("name") == "", "empty name")
        .when(builtin, "built-in name")
        .when(~F.col("value").between(1, 999), "value out of range"),
    )
    first = (
        judged.where(F.col("fault").isNull())
        .groupBy("word")
        .agg(F.min_by("value", "seq").alias("registered"))
    )
    return judged.join(first, "word", "left").select(
        "seq",
        "name",
        "value",
        F.coalesce(
            F.col("fault"), F.when(F.col("value") != F.col("registered"), "already registered")
        ).alias("error"),
    )


# --- rate limits ------------------------------------------------------------


def rate_limit_aligned(
    lines: DataFrame,
    limit: int,
    keys: Sequence[str] = ("source",),
    at: str = "ts_ms",
    used: DataFrame | None = None,
) -> DataFrame:
    """Admit the first ``limit`` lines of each key and clock second (0: all lines);
    ``used`` may give the lines already admitted per key and ``second``."""
    second = lines.withColumn("second", F.floor(F.col(at) / 1000).cast("bigint"))
    if limit <= 0:
        return second.withColumn("admitted", F.lit(True))
    return O.admit_first(second, [*keys, "second"], [at, "line_no"], limit, used=used)


def _last_starts(times: np.ndarray, span: int) -> np.ndarray:
    """For each time taken as a window start, the last start its chain reaches."""
    here = np.arange(len(times))
    following = np.searchsorted(times, times + span)
    at = np.where(following < len(times), following, here)
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return times[at]
        at = further


def window_starts(lines: DataFrame, keys: Sequence[str], at: str, span: int = 1000, block: int = 3_600_000) -> DataFrame:
    """``keys, at, window_start`` for every distinct time of every key.

    A window starts at the first time at least ``span`` after the previous start,
    so starts form a chain over the whole key.  Times are reduced to distinct
    milliseconds and cut into blocks; each block is summarised, in parallel, as
    "start carried in -> start carried out" (at most ``span`` cases), and the blocks are
    entered through a parallel prefix over these summaries.
    """
    if block < span:
        raise ValueError("a block must be at least as long as a window")
    keys = list(keys)
    if not keys:  # one window shared by all lines
        shared = window_starts(lines.withColumn("__all", F.lit(0)), ["__all"], at, span, block)
        return shared.drop("__all")
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*keys).schema)
    points = (
        lines.select(*keys, F.col(at).cast("bigint").alias("t"))
        .distinct()
        .withColumn("block", F.floor(F.col("t") / block).cast("bigint"))
    )
    form = "times array<bigint>, exits array<bigint>"

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["t"].to_numpy())
        reach = int(np.searchsorted(times, times[0] - times[0] % block + span)) + 1
        head = rows.iloc[:1][[*keys, "block"]].copy()
        head["times"] = [times[:reach]]
        head["exits"] = [_last_starts(times, span)[:reach]]
        return head

    def merge(rows: pd.DataFrame) -> dict:
        # a start carried in leads to a time of the first block, or to the first time of the next
        times, exits = np.asarray(rows["times"].iloc[0]), np.asarray(rows["exits"].iloc[0])
        for i in range(1, len(rows)):
            here, leads = np.asarray(rows["times"].iloc[i]), np.asarray(rows["exits"].iloc[i])
            found = np.searchsorted(here, exits + span)
            inside = found < len(here)
            exits = np.where(inside, leads[np.where(inside, found, 0)], exits)
            if i == 1:
                times, exits = np.append(times, here[0]), np.append(exits, leads[0])
        return {"times": times, "exits": exits}

    def enter(rows: pd.DataFrame, state: tuple) -> list[tuple]:
        entries, (start,) = [], state
        for times, exits in zip(rows["times"], rows["exits"]):
            entries.append((start,))
            at_index = 0 if start is None else int(np.searchsorted(times, start + span))
            if at_index < len(times):
                start = int(exits[at_index])
        return entries

    summaries = points.groupBy(*keys, "block").applyInPandas(summarise, f"{key_ddl}, block bigint, {form}")
    nothing = {"start": F.lit(None).cast("bigint")}
    entries = O.prefix_states(summaries, keys, form, "start bigint", nothing, merge, enter)

    def expand(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t", ignore_index=True)
        times = rows["t"].to_numpy()
        start = rows["start"].iloc[0]
        starts = np.empty(len(times), dtype="int64")
        at_index = 0 if pd.isna(start) else int(np.searchsorted(times, int(start) + span))
        starts[:at_index] = 0 if pd.isna(start) else int(start)
        while at_index < len(times):
            after = int(np.searchsorted(times, times[at_index] + span))
            starts[at_index:after] = times[at_index]
            at_index = after
        out = rows[keys].copy()
        out[at] = times
        out["window_start"] = starts
        return out

    return (
        points.join(entries, [*keys, "block"])
        .groupBy(*keys, "block")
        .applyInPandas(expand, f"{key_ddl}, `{at}` bigint, window_start bigint")
    )


def rate_limit_anchored(
    lines: DataFrame,
    limit: int,
    keys: Sequence[str] = ("source",),
    at: str = "ts_ms",
    span: int = 1000,
    block: int = 3_600_000,
) -> DataFrame:
    """Admit the first ``limit`` lines of each window that opens at the first line
    at least ``span`` ms after the previous window opened (limit 0: all lines)."""
    starts = window_starts(lines, keys, at, span, block)
    placed = lines.join(starts, [*keys, at])
    if limit <= 0:
        return placed.withColumn("admitted", F.lit(True))
    return O.admit_first(placed, [*keys, "window_start"], [at, "line_no"], limit)


# --- enrichment and filtering -------------------------------------------------


def tags_of(spec: str) -> dict[str, str]:
    """``env=prod,edge`` -> ``{"env": "prod", "edge": "true"}``."""
    pairs = (part.partition("=") for part in spec.split(",") if part.strip())
    return {k.strip(): (v.strip() if eq else "true") for k, eq, v in pairs}


def tag_table(spark: SparkSession, specs: dict[str, str]) -> DataFrame:
    """``source, tags`` of configured inputs."""
    def tag_map(spec: str) -> Column:
        pairs = [F.lit(x) for pair in tags_of(spec).items() for x in pair]
        return F.create_map(*pairs).cast("map<string,string>")

    rows = [(source, tag_map(spec)) for source, spec in specs.items()]
    return small_table(spark, ["source", "tags"], rows)


def attach_source_tags(lines: DataFrame, tags: DataFrame) -> DataFrame:
    """Left join on ``source``; a source without tags gets an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return lines.join(tags, "source", "left").withColumn("tags", F.coalesce("tags", empty))


def drop_stage(severity: Column, message: Column, predicate: Column, threshold: int, keyword: str) -> Column:
    """Name of the first stage that drops a record, null when it passes."""
    return (
        F.when(~predicate, "predicate")
        .when(severity < threshold, "level")
        .when(~L.keyword_pred(message, keyword), "keyword")
    )


def accepting_routes(record: Record, routes: Sequence[L.Route]) -> Column:
    """Names of the routes that accept a record, in route order."""
    offers = []
    for route in routes:
        seen = dict(record)
        if route.position == "before":
            seen["message"], seen["fields"] = L.transformed(record["message"], record["fields"], route.chain)
        accept = record["severity"] >= route.min_severity
        if route.predicate is not None:
            accept = accept & route.predicate(seen)
        offers.append(F.when(accept, F.lit(route.name)))
    return F.filter(F.array(*offers), lambda name: name.isNotNull())


def route_line(record: Record, routes: Sequence[L.Route], output: Column) -> Column:
    """The line a record becomes in the named output."""
    line = F.lit(None).cast("string")
    for route in reversed(routes):
        message, _ = L.transformed(record["message"], record["fields"], route.chain)
        render = L.json_line if route.format == "json" else L.text_line
        made = render(record["ts_text"], record["level"], record["source"], message)
        line = F.when(output == route.name, made).otherwise(line)
    return line


def _record() -> Record:
    return {c: F.col(c) for c in ("source", "severity", "level", "ts_text", "message", "fields")}


def log_flow(
    lines: DataFrame,
    routes: Sequence[L.Route],
    *,
    limit: int,
    threshold: int = 0,
    keyword: str = "",
    predicate: Callable[[Record], Column] | None = None,
    custom: dict[str, int] | None = None,
    tags: DataFrame | None = None,
    limiter: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per line with its fate: ``rate_dropped``, ``filtered``, ``unrouted``
    or ``written``, and the output lines it produced.

    The limiter comes before field extraction, so dropped lines are never
    scanned for fields.  ``limiter`` replaces the limit per source and second: it adds ``second``
    and ``admitted``.
    """
    limited = rate_limit_aligned(lines, limit) if limiter is None else limiter(lines)
    if tags is not None:
        limited = attach_source_tags(limited, tags)
    parsed = parse_log_line(limited, custom)
    kv = F.when(F.col("admitted"), L.kv_cascade(F.col("text"), F.col("message"), F.col("parsed")))
    extracted = once(parsed, kv=kv)
    fields = extracted.withColumn(
        "fields", F.col("kv") if tags is None else L.merge_maps(F.col("tags"), F.col("kv"))
    )
    wanted = predicate(_record()) if predicate is not None else F.lit(True)
    stage = F.when(F.col("admitted"), drop_stage(F.col("severity"), F.col("message"), wanted, threshold, keyword))
    staged = once(fields, stage=stage)
    passed = F.col("admitted") & F.col("stage").isNull()
    routed = once(staged, accepted=F.when(passed, accepting_routes(_record(), routes)))
    return routed.withColumn(
        "disposition",
        F.when(~F.col("admitted"), "rate_dropped")
        .when(F.col("stage").isNotNull(), "filtered")
        .when(F.size("accepted") == 0, "unrouted")
        .otherwise("written"),
    )


def fan_out(flow: DataFrame, routes: Sequence[L.Route]) -> DataFrame:
    """One row per record and accepting output: ``source, line_no, output, line``."""
    offered = flow.select("line_no", "ingested_ts", *_record().values(), F.explode("accepted").alias("output"))
    line = route_line(_record(), routes, F.col("output"))
    return offered.select("source", "line_no", "ingested_ts", "output", line.alias("line"))


# --- counters ---------------------------------------------------------------


def disposition_counters(flow: DataFrame, routes: Sequence[L.Route]) -> DataFrame:
    """All pipeline counters in one pass: a record gives one row per output it
    reaches, or one row if it reaches none; record counts use the first."""
    rows = flow.select(
        "disposition", *_record().values(), F.posexplode_outer("accepted").alias("place", "output")
    )
    fate = F.when(F.coalesce("place", F.lit(0)) == 0, F.col("disposition"))
    size = T.utf8_bytes(route_line(_record(), routes, F.col("output"))) + 1
    return rows.agg(
        F.count(fate).alias("ingested"),
        F.count_if(fate == "rate_dropped").alias("rate_dropped"),
        F.count_if(fate == "filtered").alias("filtered"),
        F.count_if(fate == "unrouted").alias("unrouted"),
        F.count_if(fate == "written").alias("written_records"),
        F.count("output").alias("written_lines"),
        F.coalesce(F.sum(size), F.lit(0)).alias("written_bytes"),
    )


def level_counts(records: DataFrame) -> DataFrame:
    """Lines per built-in level, zero rows included; severities above 4 count as RAW."""
    spark = records.sparkSession
    names = small_table(spark, ["severity", "level"], [(s, n) for n, s in L.SEVERITIES.items()])
    counted = records.groupBy(F.least(F.col("severity"), F.lit(4)).alias("severity")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return names.join(counted, "severity", "left").select(
        "level", F.col("severity").cast("bigint").alias("severity"), F.coalesce("n", F.lit(0)).alias("lines")
    )


def source_counters(flow: DataFrame, routes: Sequence[L.Route]) -> DataFrame:
    """Admitted lines and written bytes per source."""
    rows = flow.where("admitted").select(
        *_record().values(), F.posexplode_outer("accepted").alias("place", "output")
    )
    size = T.utf8_bytes(route_line(_record(), routes, F.col("output"))) + 1
    return rows.groupBy("source").agg(
        F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("lines"),
        F.coalesce(F.sum(size), F.lit(0)).alias("written_bytes"),
    )


def source_type_counters(lines: DataFrame) -> DataFrame:
    """Lines and distinct sources per source kind."""
    return (
        lines.groupBy("source_type", "source")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source_type")
        .agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("active_sources"))
    )


def output_counters(flow: DataFrame, routes: Sequence[L.Route]) -> DataFrame:
    return fan_out(flow, routes).groupBy("output").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(T.utf8_bytes(F.col("line")) + 1).alias("bytes")
    )


def kv_extraction_rate(flow: DataFrame) -> DataFrame:
    """Lines offered to field extraction, lines with fields, fields, rounded percent."""
    found = F.size("kv") > 0
    counted = flow.where(F.col("admitted")).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(found).alias("extracted"),
        F.coalesce(F.sum(F.size("kv")), F.lit(0)).cast("bigint").alias("fields"),
    )
    return counted.withColumn(
        "percent",
        F.when(F.col("attempted") == 0, F.lit(100).cast("bigint")).otherwise(
            F.expr("(extracted * 100 + attempted div 2) div greatest(attempted, 1)")
        ),
    )


def kv_value_counts(flow: DataFrame) -> DataFrame:
    return (
        flow.where(F.col("admitted"))
        .select(F.explode("kv").alias("key", "value"))
        .groupBy("key", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def kv_top_n(counts: DataFrame, n: int = 10) -> DataFrame:
    rank = Window.partitionBy("key").orderBy(F.col("cnt").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


# --- replay and line index ------------------------------------------------------


def line_size(text: Column) -> Column:
    """Bytes of a line that is written with a newline."""
    return T.utf8_bytes(text) + 1


def file_size(lines: DataFrame) -> Column:
    """Bytes a line takes in its file: as the reader counted them (``bytes``), which
    includes a carriage return, else the text with its newline."""
    return F.col("bytes") if "bytes" in lines.columns else line_size(F.col("text"))


def _anchors(lines: DataFrame, since_ms: int) -> DataFrame:
    in_line = T.in_line_ms(F.col("text"))
    return lines.groupBy("source").agg(F.min(F.when(in_line >= since_ms, F.col("line_no"))).alias("anchor"))


def replay_since(lines: DataFrame, since_ms: int) -> DataFrame:
    """Per source, everything from the first line stamped at or after ``since_ms``."""
    return (
        lines.join(_anchors(lines, since_ms), "source")
        .where(F.col("line_no") >= F.col("anchor"))
        .drop("anchor")
    )


def replay_skipped_bytes(lines: DataFrame, since_ms: int) -> DataFrame:
    skipped = F.col("anchor").isNull() | (F.col("line_no") < F.col("anchor"))
    return (
        lines.join(_anchors(lines, since_ms), "source")
        .groupBy("source")
        .agg(F.coalesce(F.sum(F.when(skipped, file_size(lines))), F.lit(0)).alias("skipped_bytes"))
    )


def line_offsets(lines: DataFrame, chunk: int = O.CHUNK_ROWS) -> DataFrame:
    """``source, line_no, start, end, last_ts_ms``: byte span of each line and the
    latest in-line time seen up to it (0 before the first)."""
    sized = lines.select(
        "source",
        "line_no",
        file_size(lines).alias("size"),
        T.in_line_ms(F.col("text")).alias("in_line"),
        O.chunk_of(F.col("line_no"), chunk).alias("chunk"),
    )
    seen = O.running(
        sized,
        ["source"],
        "chunk",
        ["line_no"],
        {"end": ("sum", F.col("size")), "last_ts_ms": ("last", F.col("in_line"))},
    )
    return seen.select(
        "source",
        "line_no",
        (F.col("end") - F.col("size")).alias("start"),
        "end",
        F.coalesce("last_ts_ms", F.lit(0)).alias("last_ts_ms"),
    )


def build_line_index(offsets: DataFrame, interval: int) -> DataFrame:
    """One entry per ``interval`` bytes: ``source, mark, last_ts_ms``."""
    first = F.floor(F.col("start") / interval) + 1
    last = F.floor(F.col("end") / interval)
    marks = F.transform(F.sequence(first, last), lambda k: k * interval)
    return offsets.where(last >= first).select("source", F.explode(marks).alias("mark"), "last_ts_ms")


def index_seek(index: DataFrame, probes: DataFrame, bucket: int = 60_000) -> DataFrame:
    """Per probe ``(source, since_ms)``: last mark stamped at or before it (null: scan
    the whole source) and first mark stamped at or after it."""
    seek = O.asof_last(
        index.withColumnRenamed("last_ts_ms", "at"),
        probes.withColumn("at", F.col("since_ms")),
        ["source"],
        "at",
        "mark",
        "start_mark",
        bucket,
        tiebreak="mark",
    )
    ahead = O.asof_last(
        index.select("source", (-F.col("last_ts_ms")).alias("at"), "mark", (-F.col("mark")).alias("back")),
        seek.withColumn("at", -F.col("since_ms")),
        ["source"],
        "at",
        "mark",
        "next_mark",
        bucket,
        tiebreak="back",
    )
    return ahead.select("source", "since_ms", "start_mark", "next_mark")


def replay_positioning(offsets: DataFrame, index: DataFrame, since_ms: int) -> DataFrame:
    """Per source: index hit or full scan, and the start of the line the mark is in."""
    marks = (
        index.where(F.col("last_ts_ms") <= since_ms)
        .groupBy("source")
        .agg(F.max_by("mark", F.struct("last_ts_ms", "mark")).alias("mark"))
    )
    sources = offsets.groupBy("source").agg(F.max("end").alias("size"))
    placed = sources.join(marks, "source", "left")
    aligned = (
        offsets.join(marks, "source")
        .where(F.col("start") <= F.col("mark"))
        .groupBy("source")
        .agg(F.max("start").alias("start"))
    )
    return placed.join(aligned, "source", "left").select(
        "source",
        F.when(F.col("mark").isNull(), "fallback").otherwise("index").alias("positioned_by"),
        F.coalesce("mark", F.lit(0)).alias("mark"),
        F.coalesce("start", F.lit(0)).alias("start_offset"),
    )


# --- output accounting ------------------------------------------------------------


def _cuts(prefix: np.ndarray, room: int) -> np.ndarray:
    """For each line taken as the first of a file, the first line of the next file."""
    before = np.concatenate([[0], prefix[:-1]])
    following = np.searchsorted(prefix, before + room, side="right")
    return np.maximum(following, np.arange(1, len(prefix) + 1))


_BLOCK_FORM = "lines bigint, total bigint, prefix array<bigint>, opened array<bigint>, left array<bigint>"


def size_rotation_plan(
    written: DataFrame, max_bytes: int, header_bytes: int, block_lines: int = 1_000_000
) -> DataFrame:
    """Assign output lines to numbered files of at most ``max_bytes``.

    ``written`` holds ``output, day, seq, bytes``.  A file ends before the line that would exceed
    the limit; a line that alone exceeds it has a file of its own.  Where files end
    depends on all lines before, so lines are cut into blocks of ``block_lines``
    positions; each block is summarised, in parallel, as "bytes in the open file before ->
    files opened, bytes in the open file after" (only lines within one file's size of its
    start can be its first cut), and blocks are entered through a parallel prefix over these
    summaries, whose rounds are written while the plan is built.  The numbers do not depend on
    the block size.
    """
    if block_lines < 1 or header_bytes >= max_bytes:
        raise ValueError("block_lines must be positive and the header smaller than a file")
    room = max_bytes - header_bytes
    blocked = written.select("output", "day", "seq", "bytes", O.chunk_of(F.col("seq"), block_lines).alias("block"))
    place = ["output", "day", "block"]

    def reach_of(prefix: np.ndarray) -> int:
        return int(np.searchsorted(prefix, room, side="right")) + 2

    def summary(lines: int, total: int, prefix, opened, left) -> dict:
        return {"lines": lines, "total": total, "prefix": prefix, "opened": opened, "left": left}

    def running(sizes: np.ndarray) -> np.ndarray:
        return sizes.cumsum() if sizes.dtype.kind == "i" else pd.Series(sizes).cumsum().to_numpy()

    def summarise(prefix: np.ndarray) -> dict:
        reach = reach_of(prefix)
        following = _cuts(prefix, room)
        here = np.arange(len(prefix))
        at = np.where(following < len(prefix), following, here)
        opened = 1 + (at != here)
        while True:  # follow all chains to their last file, doubling the steps
            further = at[at]
            if np.array_equal(further, at):
                break
            opened = opened + opened[at] - 1
            at = further
        left = header_bytes + prefix[-1] - np.concatenate([[0], prefix[:-1]])[at]
        return summary(len(prefix), int(prefix[-1]), prefix[:reach], opened[:reach], left[:reach])

    forms = O.columns_of(_BLOCK_FORM)

    def summarised(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        sizes = rows.column("bytes").to_numpy()
        found = [summarise(running(sizes[a:b])) for a, b in zip(starts[:-1], starts[1:])]
        values = [pa.array([f[n] for f in found], kind) for n, kind in forms.items()]
        return pa.Table.from_arrays([*rows.select(place).take(starts[:-1]).columns, *values], [*place, *forms])

    line = ["seq", "bytes"]
    summaries = O.in_groups(blocked, place, line, f"output string, day string, block bigint, {_BLOCK_FORM}", summarised)

    def first_cut(prefix: np.ndarray, used: int) -> int:
        cut = int(np.searchsorted(prefix, max_bytes - used, side="right"))
        return max(cut, 1) if used == 0 else cut  # an empty file takes any line

    def merge(rows: pd.DataFrame) -> dict:
        lines, total = 0, 0
        prefix, opened, left = (np.empty(0, np.int64) for _ in range(3))
        for block in rows.itertuples():
            cut = np.searchsorted(block.prefix, max_bytes - left, side="right")
            cut = np.where(left == 0, np.maximum(cut, 1), cut)
            inside = cut < len(block.prefix)
            cut = np.where(inside, cut, 0)
            opened = opened + np.where(inside, np.asarray(block.opened)[cut], 0)
            left = np.where(inside, np.asarray(block.left)[cut], left + block.total)
            if len(prefix) == lines:  # all lines so far may be passed without a cut
                prefix = np.concatenate([prefix, total + np.asarray(block.prefix)])
                opened, left = np.concatenate([opened, block.opened]), np.concatenate([left, block.left])
                reach = reach_of(prefix)
                prefix, opened, left = prefix[:reach], opened[:reach], left[:reach]
            lines, total = lines + int(block.lines), total + int(block.total)
        return summary(lines, total, prefix, opened, left)

    def enter(rows: pd.DataFrame, state: tuple) -> list[tuple]:
        (used, number), entries = state, []
        for total, prefix, opened, left in zip(rows["total"], rows["prefix"], rows["opened"], rows["left"]):
            entries.append((used, number))
            cut = first_cut(prefix, used)
            if cut < len(prefix):
                used, number = int(left[cut]), number + int(opened[cut])
            else:
                used += int(total)
        return entries

    start = {"used": F.lit(header_bytes).cast("bigint"), "number": F.lit(0).cast("bigint")}
    entries = O.prefix_states(summaries, ["output", "day"], _BLOCK_FORM, "used bigint, number bigint", start, merge, enter)

    def expanded(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        sizes = rows.column("bytes").to_numpy()
        entered = (rows.column(c).take(starts[:-1]).to_pylist() for c in ("used", "number"))
        files = np.zeros(rows.num_rows, np.int64)
        for a, b, used, number in zip(starts[:-1], starts[1:], *entered):
            prefix = running(sizes[a:b])
            following = _cuts(prefix, room)
            opens = np.zeros(len(prefix), np.int64)
            at = first_cut(prefix, used)
            while at < len(prefix):
                opens[at] = 1
                at = int(following[at])
            files[a:b] = number + opens.cumsum()
        kept = ["output", "day", "seq", "bytes"]
        return pa.Table.from_arrays([*rows.select(kept).columns, pa.array(files)], [*kept, "file_no"])

    form = "output string, day string, seq bigint, bytes bigint, file_no bigint"
    return O.in_groups(blocked.join(entries, place), place, line, form, expanded)


def compression_report(written: DataFrame) -> DataFrame:
    """Raw and run-length packed bytes per output."""
    return (
        written.groupBy("output")
        .agg(
            F.sum(T.utf8_bytes(F.col("line"))).alias("raw_bytes"),
            F.sum(T.run_length_packed_bytes(F.col("line"))).alias("packed_bytes"),
        )
        .withColumn("percent", F.expr("packed_bytes * 100 div raw_bytes"))
    )


def run_length_rows(
    rows: DataFrame, keys: Sequence[str], position: str, value: str, chunk: int = O.CHUNK_ROWS
) -> DataFrame:
    """Collapse consecutive equal values: ``keys, value, first, last, n``.

    Positions must be dense per key.
    """
    keys = list(keys)
    near = O.with_halo(rows.select(*keys, position, value), position, before=1, size=chunk)
    inside = Window.partitionBy(*keys, "chunk").orderBy(position)
    earlier = F.lag(F.struct(F.col(value).alias("v"))).over(inside)
    changed = earlier.isNull() | ~earlier["v"].eqNullSafe(F.col(value))
    marked = near.withColumn("__start", F.when(changed, F.col(position))).where(~F.col("halo")).drop("halo")
    runs = O.running(marked, keys, "chunk", [position], {"__run": ("last", F.col("__start"))})
    return runs.groupBy(*keys, F.col("__run").alias("first"), value).agg(
        F.max(position).alias("last"), F.count(F.lit(1)).alias("n")
    )


def run_length_expand(runs: DataFrame, position: str) -> DataFrame:
    """Inverse of :func:`run_length_rows`."""
    return runs.select(
        *[c for c in runs.columns if c not in ("first", "last", "n")],
        F.explode(F.sequence("first", "last")).alias(position),
    )


# --- exposition text ------------------------------------------------------------

# Metric families in output order with their type; the help texts are our own.
FAMILIES = [
    ("lines_ingested_total", "counter", "Lines read, by level and in all."),
    ("lines_filtered_total", "counter", "Lines that a filter stage left out."),
    ("lines_written_total", "counter", "Lines handed to outputs."),
    ("output_bytes_total", "counter", "Bytes handed to outputs."),
    ("lines_rate_dropped_total", "counter", "Lines over the rate limit."),
    ("compression_raw_bytes_total", "counter", "Bytes of output lines before packing."),
    ("compression_packed_bytes_total", "counter", "Bytes of output lines after packing."),
    ("output_rotations_total", "counter", "Files begun anew, by what began them."),
    ("kv_lines_attempted_total", "counter", "Lines searched for fields."),
    ("kv_lines_extracted_total", "counter", "Lines in which fields were found."),
    ("kv_fields_extracted_total", "counter", "Fields found."),
    ("kv_extraction_ratio", "gauge", "Share of searched lines with fields, in percent."),
    ("replay_index_hits_total", "counter", "Sources that a replay entered by their index."),
    ("replay_index_fallbacks_total", "counter", "Sources that a replay read from their start."),
    ("replay_skipped_bytes_total", "counter", "Bytes that a replay passed over."),
    ("source_lines_total", "counter", "Lines read from each source."),
    ("source_output_bytes_total", "counter", "Bytes written for each source."),
    ("output_lines_written_total", "counter", "Lines in each output."),
    ("output_bytes_written_total", "counter", "Bytes in each output."),
    ("source_type_lines_total", "counter", "Lines read from each kind of source."),
    ("source_type_active", "gauge", "Sources of each kind that delivered lines."),
    ("field_value_count", "counter", "Values found for each field."),
]


def escape_label(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def _observed(flow: DataFrame, routes: Sequence[L.Route]) -> tuple[DataFrame, Observation]:
    """Write what the labelled counters need of a flow, and take all other counters on the way.

    Levels and outputs are known beforehand, so their counters are plain sums that Spark observes
    while the rows are written; nothing is shuffled for them.
    """
    lines = once(
        flow,
        **{
            f"line{i}": F.when(F.array_contains("accepted", r.name), route_line(_record(), [r], F.lit(r.name)))
            for i, r in enumerate(routes)
        },
    )
    fate, admitted, fields = F.col("disposition"), F.col("admitted"), F.size("kv")
    total = lambda value: F.coalesce(F.sum(value), F.lit(0)).cast("bigint")
    counters = {
        "ingested": F.count(F.lit(1)),
        "filtered": F.count_if(fate == "filtered"),
        "written": F.count_if(fate == "written"),
        "rate_dropped": F.count_if(~admitted),
        "attempted": F.count_if(admitted),
        "extracted": F.count_if(admitted & (fields > 0)),
        "fields": total(F.when(admitted, fields)),
    }
    counters |= {f"level{s}": F.count_if(F.least("severity", F.lit(4)) == s) for s in L.SEVERITIES.values()}
    size = F.lit(0)
    for i in range(len(routes)):
        line = F.col(f"line{i}")
        size = size + F.coalesce(line_size(line), F.lit(0))
        counters |= {
            f"lines{i}": F.count(line),
            f"bytes{i}": total(line_size(line)),
            f"raw{i}": total(T.utf8_bytes(line)),
            f"packed{i}": total(T.run_length_packed_bytes(line)),
        }
    seen = Observation()
    narrow = lines.observe(seen, *[c.alias(n) for n, c in counters.items()]).select(
        "source", "source_type", "admitted", F.when(admitted, F.col("kv")).alias("kv"), size.cast("bigint").alias("size")
    )
    return stored(narrow, "metrics"), seen


def metric_facts(flow: DataFrame, routes: Sequence[L.Route], top: int) -> DataFrame:
    """All counters as ``family, key, value, n``; the flow is computed once, while the plan is built."""
    narrow, seen = _observed(flow, routes)
    n = seen.get
    ratio = 100 if n["attempted"] == 0 else (n["extracted"] * 100 + n["attempted"] // 2) // n["attempted"]
    every = range(len(routes))
    plain = {
        "lines_ingested_total": n["ingested"],
        "lines_filtered_total": n["filtered"],
        "lines_written_total": n["written"],
        "output_bytes_total": sum(n[f"bytes{i}"] for i in every),
        "lines_rate_dropped_total": n["rate_dropped"],
        "compression_raw_bytes_total": sum(n[f"raw{i}"] for i in every),
        "compression_packed_bytes_total": sum(n[f"packed{i}"] for i in every),
        "kv_lines_attempted_total": n["attempted"],
        "kv_lines_extracted_total": n["extracted"],
        "kv_fields_extracted_total": n["fields"],
        "kv_extraction_ratio": ratio,
    }
    rows = [(family, "", "", int(count)) for family, count in plain.items()]
    rows += [("lines_ingested_total", name, "", int(n[f"level{s}"])) for name, s in L.SEVERITIES.items()]
    for i, route in enumerate(routes):
        if n[f"lines{i}"]:
            rows.append(("output_lines_written_total", route.name, "", int(n[f"lines{i}"])))
            rows.append(("output_bytes_written_total", route.name, "", int(n[f"bytes{i}"])))
    known = small_table(flow.sparkSession, ["family", "key", "value", "n"], rows).withColumn("n", F.col("n").cast("bigint"))

    def fact(family: str, key: str, count: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), F.col(key).alias("key"), count.cast("bigint").alias("n"))

    sources = narrow.groupBy("source_type", "source").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("admitted").alias("admitted"), F.sum(F.when(F.col("admitted"), F.col("size"))).alias("bytes")
    )
    of_type = F.array(
        fact("source_type_lines_total", "source_type", F.col("lines")), fact("source_type_active", "source_type", F.lit(1))
    )
    of_source = F.array(
        fact("source_lines_total", "source", F.col("admitted")), fact("source_output_bytes_total", "source", F.col("bytes"))
    )
    none = F.slice(of_type, F.lit(1), F.lit(0))
    labelled = (
        sources.select(F.inline(F.concat(of_type, F.when(F.col("admitted") > 0, of_source).otherwise(none))))
        .groupBy("family", "key")
        .agg(F.sum("n").alias("n"))
        .select("family", "key", F.lit("").alias("value"), "n")
    )
    values = kv_top_n(kv_value_counts(narrow), top).select(
        F.lit("field_value_count").alias("family"), "key", "value", F.col("cnt").alias("n")
    )
    return known.unionByName(labelled).unionByName(values)


def rotation_facts(plan: DataFrame) -> DataFrame:
    """Rotations by size and by day of a :func:`size_rotation_plan`, for :func:`prometheus_lines`."""
    days = plan.groupBy("output", "day").agg(F.max("file_no").alias("files"))
    outputs = days.groupBy("output").agg(F.sum("files").alias("by_size"), (F.count(F.lit(1)) - 1).alias("by_day"))
    summed = outputs.agg(F.coalesce(F.sum("by_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("by_day"), F.lit(0)).alias("day"))
    return summed.unpivot([], ["size", "day"], "key", "n").select(F.lit("output_rotations_total").alias("family"), "key", F.col("n").cast("bigint").alias("n"))


def replay_facts(positions: DataFrame, skipped: DataFrame) -> DataFrame:
    """Hits, misses and skipped bytes of a replay (:func:`replay_positioning`,
    :func:`replay_skipped_bytes`), for :func:`prometheus_lines`."""
    hits = positions.agg(
        F.count_if(F.col("positioned_by") == "index").alias("replay_index_hits_total"),
        F.count_if(F.col("positioned_by") == "fallback").alias("replay_index_fallbacks_total"),
    )
    passed = skipped.agg(F.coalesce(F.sum("skipped_bytes"), F.lit(0)).cast("bigint").alias("replay_skipped_bytes_total"))
    long = hits.unpivot([], hits.columns, "family", "n").unionByName(passed.unpivot([], passed.columns, "family", "n"))
    return long.select("family", F.lit("").alias("key"), "n")


# Label each family carries.
LABELS = {
    "lines_ingested_total": "level",
    "source_lines_total": "source",
    "source_output_bytes_total": "source",
    "output_rotations_total": "trigger",
    "output_lines_written_total": "output",
    "output_bytes_written_total": "output",
    "source_type_lines_total": "type",
    "source_type_active": "type",
}


def prometheus_lines(
    flow: DataFrame, routes: Sequence[L.Route], top: int = 10, prefix: str = "opslens_", more: Sequence[DataFrame] = ()
) -> DataFrame:
    """Exposition text as ``family_no, kind, label, text`` rows in output order.

    ``more`` may give further counters as ``family, key, n``: :func:`rotation_facts` and
    :func:`replay_facts`.  The flow is computed once, while the plan is built.
    """
    spark = flow.sparkSession
    long = metric_facts(flow, routes, top)
    for facts in more:
        long = long.unionByName(facts.select("family", "key", F.lit("").alias("value"), F.col("n").cast("bigint").alias("n")))
    long = stored(long, "metric-facts")
    families = small_table(
        spark,
        ["family_no", "family", "type", "help", "label_name"],
        [(i, name, kind, text, LABELS.get(name, "")) for i, (name, kind, text) in enumerate(FAMILIES)],
    )
    one_label = F.concat(F.lit("{"), F.col("label_name"), F.lit('="'), escape_label(F.col("key")), F.lit('"}'))
    two_labels = F.concat(
        F.lit('{key="'), escape_label(F.col("key")), F.lit('",value="'), escape_label(F.col("value")), F.lit('"}')
    )
    label = (
        F.when(F.col("family") == "field_value_count", two_labels)
        .when(F.col("key") == "", "")
        .otherwise(one_label)
    )
    named = long.join(families, "family").withColumn("label", label)
    body = named.select(
        "family_no",
        F.when(F.col("label") == "", 3).otherwise(2).alias("kind"),
        "label",
        F.concat(F.lit(prefix), F.col("family"), F.col("label"), F.lit(" "), F.col("n").cast("string")).alias("text"),
    )
    name = F.concat(F.lit(prefix), F.col("family"), F.lit(" "))
    heads = (
        named.select("family_no", "family", "type", "help")
        .distinct()
        .select(
            "family_no",
            F.inline(
                F.array(
                    F.struct(
                        F.lit(0).alias("kind"), F.lit("").alias("label"),
                        F.concat(F.lit("# HELP "), name, F.col("help")).alias("text"),
                    ),
                    F.struct(
                        F.lit(1).alias("kind"), F.lit("").alias("label"),
                        F.concat(F.lit("# TYPE "), name, F.col("type")).alias("text"),
                    ),
                )
            ),
        )
    )
    return heads.unionByName(body).orderBy("family_no", "kind", "label")


def retention_prune(exports: DataFrame, keep: int) -> DataFrame:
    """Names to delete when each base keeps its newest ``keep`` exports.

    Exports are named ``<base>_<yyyymmdd>_<hhmmss>...prom``; other names are left alone.
    """
    shape = r"\A(.+?)_\d{8}_\d{6}[\s\S]*\.prom\z"
    based = exports.withColumn("base", F.regexp_extract("name", shape, 1)).where(F.col("base") != "")
    newest = Window.partitionBy("base").orderBy(F.col("name").desc())
    oldest_kept = (
        based.withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= max(keep, 1))
        .groupBy("base")
        .agg(F.min("name").alias("oldest_kept"))
    )
    return based.join(oldest_kept, "base").where(F.col("name") < F.col("oldest_kept")).select("base", "name")


# --- layered settings -------------------------------------------------------------

# Former names of settings.
RENAMED = {
    "input.file": "input.files",
    "rotate_daily": "rotate.daily",
    "extract_kv": "extract.kv",
    "output_format": "output.format",
    "max_lines_per_sec": "rate.max_lines_per_sec",
    "stop_file": "run.stop_file",
}
LAYERS = {"file": 0, "profile": 1, "env": 2}


def overlay_merge(entries: DataFrame, profile: str) -> DataFrame:
    """Effective value of each setting of each app and the layer it came from."""
    names = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    rank = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])
    active = entries.where((F.col("layer") != "profile") | (F.col("profile") == profile))
    named = active.withColumn("name", F.coalesce(F.try_element_at(names, "key"), F.col("key")))
    return (
        named.groupBy("app", "name")
        .agg(
            F.max_by(
                F.struct("value", "layer", (F.col("key") != F.col("name")).alias("renamed")),
                F.struct(F.try_element_at(rank, "layer"), "seq"),
            ).alias("won")
        )
        .select("app", F.col("name").alias("key"), "won.value", "won.layer", "won.renamed")
    )
