"""Structured Streaming flows.

Every flow writes one folder per micro-batch below ``out`` and overwrites that
folder when a batch is replayed, so a restart after a failure neither loses nor
repeats rows.  Results are read back from those folders; nothing is kept in the
driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import logline as L
from opslens.operators import logs as ops
from opslens.operators import results as R
from opslens.sources.readers import file_lines, number_file_lines
from opslens.session import remove_dir
from opslens.streaming import limits


def stream_log_lines(spark: SparkSession, path: str, source_type: str = "file", per_batch: int | None = None) -> DataFrame:
    """Lines of the log files landing in a folder, each file read once.

    Files must be complete when they appear; new files are picked up while the
    stream runs and after a restart from its checkpoint.
    """
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return file_lines(reader.text(path), source_type)


def stream_table(spark: SparkSession, path: str, schema, per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder (or glob) as a stream."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def _epoch_dir(out: str, epoch: int) -> str:
    return f"{out}/epoch={epoch:012d}"


def _previous(spark: SparkSession, out: str, epoch: int, schema: str) -> DataFrame:
    """State written by the batch before, empty at the start.  State that is missing later
    is an error: the flow must not begin anew by itself."""
    if epoch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_epoch_dir(out, epoch - 1))


def drop_epochs(spark: SparkSession, folder: str, epoch: int, keep: int = 2) -> None:
    """Remove the folder of the one epoch that ``keep`` newer ones have replaced.  Spark
    replays the last batch at most, so older ones are never written again."""
    if epoch >= keep:
        remove_dir(spark, _epoch_dir(folder, epoch - keep))


def run_available(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    interval: str | None = None,
):
    """Run a batch function over a stream: all data there is now, or every
    ``interval`` until stopped.  Returns the streaming query."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    if interval:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _append_batches(
    stream: DataFrame,
    out: str,
    build: Callable[[DataFrame, int], DataFrame],
    mode: str = "append",
    interval: str | None = None,
):
    def each(batch: DataFrame, epoch: int) -> None:
        build(batch, epoch).write.mode("overwrite").parquet(_epoch_dir(out, epoch))

    return run_available(stream, each, f"{out}-checkpoint", mode, interval)


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """All rows written by a flow, with their ``epoch``."""
    return spark.read.option("basePath", out).parquet(f"{out}/epoch=*")


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest row of each key among update rows."""
    others = [c for c in updates.columns if c not in (*keys, "epoch")]
    newest = F.max_by(F.struct(*others), "epoch").alias("row")
    return updates.groupBy(*keys).agg(newest).select(*keys, "row.*")


# --- flows ------------------------------------------------------------------------


def _lines_and_decisions(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Lines and the limiter's decisions about them as one stream, so that a batch delivers both
    and their state advances with the query's own checkpoint."""
    named = decided.select(F.struct(*decided.columns).alias("decision"))
    return lines.withColumn("decision", F.lit(None).cast(named.schema["decision"].dataType)).unionByName(
        named, allowMissingColumns=True
    )


def _landed(batch: DataFrame, folder: str, epoch: int) -> tuple[DataFrame, DataFrame]:
    """Write a batch of :func:`_lines_and_decisions` and read both parts back; a batch must not
    be computed twice, as its state would be."""
    batch.write.mode("overwrite").parquet(_epoch_dir(folder, epoch))
    rows = batch.sparkSession.read.schema(batch.schema).parquet(_epoch_dir(folder, epoch))
    return rows.where("decision IS NULL").drop("decision"), rows.where("decision IS NOT NULL").select("decision.*")


def stream_rate_limit(
    lines: DataFrame, out: str, limit: int, span: int = 1000, delay: str = "1 hour", hold: bool = False
):
    """Anchored rate limit over a stream of ``source, line_no, ts_ms``; :func:`read_limited`
    reads the judged lines.

    Each source's window is Spark's state, dropped by a timer once the watermark (``delay``
    behind the newest line) has passed it.  Lines are judged in the order of their times inside
    a batch and in the order of arrival over batches; with ``hold`` they wait until the
    watermark has passed them, so lines out of order by less than ``delay`` are judged as
    the batch operator judges them.  Lines behind the watermark, and lines without a source, time or
    number, are not admitted.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        rows, decided = _landed(batch, f"{out}/landed", epoch)
        decided.write.mode("overwrite").parquet(_epoch_dir(f"{out}/decisions", epoch))
        rows.write.mode("overwrite").parquet(_epoch_dir(f"{out}/lines", epoch))
        drop_epochs(rows.sparkSession, f"{out}/landed", epoch)

    decided = limits.decisions(lines, limits.AnchoredLimit(limit, span, hold), 1, delay)
    return run_available(_lines_and_decisions(lines, decided), each, f"{out}-checkpoint")


def read_limited(spark: SparkSession, out: str, hold: bool = False) -> DataFrame:
    """Lines of :func:`stream_rate_limit` with ``window_start`` and ``admitted``; held lines
    that the watermark has not passed have neither yet."""
    lines = read_batches(spark, f"{out}/lines")
    # a millisecond has one decision per batch it arrived in, and one in all when lines are held
    keys = ["source", "ts_ms"] if hold else ["epoch", "source", "ts_ms"]
    decided = read_batches(spark, f"{out}/decisions").select(*keys, "window_start", "last_line", F.lit(True).alias("known"))
    admitted = F.coalesce(F.col("line_no") <= F.col("last_line"), F.lit(False))
    pending = F.col("known").isNull() & F.lit(hold)
    return lines.join(decided, keys, "left").withColumn("admitted", F.when(~pending, admitted)).drop("last_line", "known")


def stream_log_flow(lines: DataFrame, out: str, routes, *, limit: int, late_seconds: int = 3600, **options):
    """Parse, limit, extract, filter and route a stream; the output rows of
    ``fan_out`` are written batch by batch, partitioned by output.

    The limit counts per source and clock second.  A second keeps its count over batches, in
    Spark's state, until the watermark, ``late_seconds`` behind the newest line, has passed it; a
    line that comes later than that opens its second anew.  Each batch is computed once: its judged
    lines are written, and outputs and counts are derived from them.
    """
    flows = f"{out}-flow"

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        limiter = None
        if limit > 0:
            batch, decided = _landed(batch, f"{out}-landed", epoch)
            limiter = _judge(decided, limit)
        judged = ops.log_flow(batch, routes, limit=limit, limiter=limiter, **options)
        judged.write.mode("overwrite").parquet(_epoch_dir(flows, epoch))
        flow = spark.read.schema(judged.schema).parquet(_epoch_dir(flows, epoch))
        ops.fan_out(flow, routes).write.mode("overwrite").partitionBy("output").parquet(_epoch_dir(out, epoch))
        counts = _flow_counts(flow, routes)
        before = _previous(spark, f"{out}-counters", epoch, "family string, label string, n bigint")
        total = counts.unionByName(before).groupBy("family", "label").agg(F.sum("n").cast("bigint").alias("n"))
        total.write.mode("overwrite").parquet(_epoch_dir(f"{out}-counters", epoch))
        for folder in (f"{out}-landed", f"{out}-counters", flows):
            drop_epochs(spark, folder, epoch)

    stream = lines
    if limit > 0:
        decided = limits.decisions(lines, limits.SecondLimit(limit), 1000, f"{late_seconds} seconds")
        stream = _lines_and_decisions(lines, decided)
    return run_available(stream, each, f"{out}-checkpoint")


def _judge(decided: DataFrame, limit: int) -> Callable[[DataFrame], DataFrame]:
    """Admit lines up to the last one the state let in; a second it does not know, as it was behind
    the watermark, is judged by the batch alone."""
    known = decided.select(
        "source",
        F.col("slot").alias("second"),
        F.struct(F.col("last_ts").alias("ts_ms"), F.col("last_line").alias("line_no")).alias("__last"),
    )

    def limiter(lines: DataFrame) -> DataFrame:
        placed = lines.withColumn("second", F.floor(F.col("ts_ms") / 1000).cast("bigint")).join(
            known, ["source", "second"], "left"
        )
        here = F.col("__last.ts_ms").isNotNull() & (F.struct("ts_ms", "line_no") <= F.col("__last"))
        in_time = placed.where("__last IS NOT NULL").withColumn("admitted", here).drop("__last")
        late = placed.where("__last IS NULL").drop("__last", "second")
        return in_time.unionByName(ops.rate_limit_aligned(late, limit))

    return limiter


def _flow_counts(flow: DataFrame, routes) -> DataFrame:
    """``family, label, n``: a batch's counters by disposition, source, level, output and
    field extraction; two grouped passes over the batch's judged lines."""

    def one(family: str, label: Column, n: Column | int = 1, when: Column | None = None) -> Column:
        entry = F.struct(F.lit(family).alias("family"), label.alias("label"), F.lit(n).cast("bigint").alias("n"))
        return entry if when is None else F.when(when, entry)

    admitted, fields = F.col("admitted"), F.size("kv")
    kinds = F.array(
        one("disposition", F.col("disposition")),
        one("source", F.col("source"), when=admitted),
        one("level", L.level_name(F.col("severity"))),
        one("kv", F.lit("attempted"), when=admitted),
        one("kv", F.lit("extracted"), when=admitted & (fields > 0)),
        one("kv", F.lit("fields"), fields, when=admitted & (fields > 0)),
    )
    lines = flow.select(F.inline(F.filter(kinds, lambda k: k.isNotNull())))
    written = ops.output_counters(flow, routes)
    outputs = written.select(
        F.inline(F.array(one("output_lines", F.col("output"), F.col("lines")), one("output_bytes", F.col("output"), F.col("bytes"))))
    )
    return lines.groupBy("family", "label").agg(F.sum("n").alias("n")).unionByName(outputs)


def flow_counters(spark: SparkSession, out: str) -> DataFrame:
    """All counters of a :func:`stream_log_flow` up to its last batch."""
    return last_snapshot(spark, f"{out}-counters")


def stream_counters(
    lines: DataFrame, out: str, custom: dict[str, int] | None = None, interval: str | None = None
):
    """Cumulative lines per level; every batch, or every ``interval``, writes a whole
    snapshot and the last one is final."""
    parsed = ops.parse_log_line(lines, custom)
    counts = parsed.groupBy(F.least("severity", F.lit(4)).alias("severity")).agg(F.count(F.lit(1)).alias("lines"))
    named = counts.withColumn("level", L.level_name(F.col("severity")))
    return _append_batches(named, out, lambda batch, _epoch: batch, "complete", interval)


def last_snapshot(spark: SparkSession, out: str) -> DataFrame:
    """Rows of the newest batch folder; the others are not opened."""
    newest = read_batches(spark, out).agg(F.max("epoch")).first()[0]
    return spark.read.parquet(_epoch_dir(out, newest or 0))


def stream_window_counts(lines: DataFrame, out: str, at: str, width: str, delay: str, custom: dict[str, int] | None = None):
    """Lines per tumbling window of event time and level; lines later than ``delay``
    behind the newest are left out."""
    parsed = ops.parse_log_line(lines, custom).withColumn("event_time", F.col(at).cast("timestamp"))
    counts = (
        parsed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width).alias("w"), "level")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select(F.col("w.start").alias("window_start"), "level", "lines")
    )
    return _append_batches(counts, out, lambda batch, _epoch: batch, "update")


#: So many neighbouring folders of a level are merged into one of the next.
MERGE_FAN = 16
_KV_COUNTS = "key string, value string, cnt bigint"


def _level_dir(out: str, level: int, number: int) -> str:
    return f"{out}/level={level}/part={number:012d}"


def merge_levels(batches: int, fan: int = MERGE_FAN) -> list[tuple[int, int]]:
    """``(level, number)`` of the folders that hold the first ``batches`` batches: part ``n`` of
    level ``l`` holds ``fan ** l`` batches from ``n * fan ** l`` on."""
    parts, start, level = [], 0, 0
    while fan ** (level + 1) <= batches:
        level += 1
    for size in range(level, -1, -1):
        while start + fan**size <= batches:
            parts.append((size, start // fan**size))
            start += fan**size
    return parts


def stream_kv_counts(lines: DataFrame, out: str, custom: dict[str, int] | None = None, fan: int = MERGE_FAN):
    """Counts of every field value, kept in merge levels.

    A batch writes its own counts; ``fan`` folders of a level become one of the next,
    so a count is rewritten once per level and not once per batch.  What a merge has replaced is
    removed one batch later, when the merge is known to have ended, and a marker tells readers
    how many batches are whole.  A replayed batch overwrites its own folders only.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        for level, number in _merged_away(epoch, fan):
            remove_dir(spark, _level_dir(out, level, number))
        parsed = ops.parse_log_line(batch, custom)
        kv = L.kv_cascade(F.col("text"), F.col("message"), F.col("parsed"))
        here = parsed.select(F.explode(kv).alias("key", "value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("cnt"))
        here.write.mode("overwrite").parquet(_level_dir(out, 0, epoch))
        level, done = 0, epoch + 1
        while done % fan == 0:
            done //= fan
            parts = [_level_dir(out, level, n) for n in range((done - 1) * fan, done * fan)]
            level += 1
            whole = spark.read.schema(_KV_COUNTS).parquet(*parts).groupBy("key", "value").agg(F.sum("cnt").alias("cnt"))
            whole.write.mode("overwrite").parquet(_level_dir(out, level, done - 1))
        spark.range(epoch + 1, epoch + 2).toDF("batches").coalesce(1).write.mode("overwrite").parquet(_epoch_dir(f"{out}/done", epoch))
        drop_epochs(spark, f"{out}/done", epoch)

    return run_available(lines, each, f"{out}-checkpoint")


def _merged_away(batches: int, fan: int) -> list[tuple[int, int]]:
    """Folders that the merges after ``batches`` batches have replaced."""
    gone, level = [], 0
    while batches and batches % fan == 0:
        batches //= fan
        gone += [(level, n) for n in range((batches - 1) * fan, batches * fan)]
        level += 1
    return gone


def kv_counts(spark: SparkSession, out: str, fan: int = MERGE_FAN) -> DataFrame:
    """``key, value, cnt`` over all whole batches of :func:`stream_kv_counts`."""
    batches = read_batches(spark, f"{out}/done").agg(F.max("batches")).first()[0]
    parts = [_level_dir(out, *p) for p in merge_levels(batches, fan)]
    return spark.read.schema(_KV_COUNTS).parquet(*parts).groupBy("key", "value").agg(F.sum("cnt").alias("cnt"))


def kv_top_n(spark: SparkSession, out: str, n: int = 10, fan: int = MERGE_FAN) -> DataFrame:
    """Top values per key over all batches written so far."""
    return ops.kv_top_n(kv_counts(spark, out, fan), n)


def stream_result_stats(lines: DataFrame, out: str):
    """Status counts per tag, maintained while result lines arrive."""
    return _append_batches(R.tag_status_stats(R.parse_task_result(lines)), out, lambda batch, _epoch: batch, "update")


def land_log_files(lines: DataFrame, out: str):
    """Land the lines of :func:`stream_log_lines` with their numbers.  A file is read
    in one batch, so numbers equal those of the batch reader."""

    def numbered(batch: DataFrame, _epoch: int) -> DataFrame:
        return number_file_lines(batch).withColumn("ingested_ts", F.current_timestamp())

    return _append_batches(lines, out, numbered)


def land_lines(lines: DataFrame, out: str):
    """Land a stream of lines as they are."""
    return _append_batches(lines, out, lambda batch, _epoch: batch)
