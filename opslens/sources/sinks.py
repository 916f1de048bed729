"""Partitioned text outputs.

Rows are rebalanced by the partition column first: small days share a writer, a
day or source that holds much of the data is split over many, and each folder gets
few files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.text import safe_source_name


def _write(rows: DataFrame, folder: str, path: str, mode: str) -> None:
    rows.hint("rebalance", folder).write.partitionBy(folder).mode(mode).text(path)


def write_daily(lines: DataFrame, line: Column, at: Column, path: str, mode: str = "append") -> None:
    """Text files in one folder per calendar day, ``dt=yyyy-MM-dd``."""
    day = F.date_format(at, "yyyy-MM-dd")
    _write(lines.select(line.alias("value"), day.alias("dt")), "dt", path, mode)


def write_per_source(lines: DataFrame, line: Column, path: str, mode: str = "append") -> None:
    """Text files in one folder per input source, named after the file."""
    named = lines.select(line.alias("value"), safe_source_name(F.col("source")).alias("name"))
    _write(named, "name", path, mode)


def write_outputs(fanned: DataFrame, path: str, mode: str = "append") -> None:
    """Text files in one folder per output of ``fan_out`` rows."""
    _write(fanned.select(F.col("line").alias("value"), "output"), "output", path, mode)


def write_task_results(results: DataFrame, text: Column, at: Column, path: str, mode: str = "append") -> None:
    """Result lines in one folder per day, ``day=yyyyMMdd``."""
    day = F.date_format(at, "yyyyMMdd")
    _write(results.select(text.alias("value"), day.alias("day")), "day", path, mode)


def write_report(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Report lines in order; part files follow the order of their names."""
    lines.orderBy("section", "place").select(F.col("text").alias("value")).write.mode(mode).text(path)


def write_files(files: DataFrame, root: str) -> int:
    """One file per ``path, text`` row below ``root``, a URI that all executors reach; returns their number.

    A task that is run again writes the same files with the same content.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                folder = f"{top}/{path}".rpartition("/")[0]
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{top}/{path}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "text").mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
