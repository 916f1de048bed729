"""Helpers that steer where work is done: once per row, on all cores, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import fresh_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder now and read them back: they are computed once and
    need no executor to survive."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    Plain projections are merged with the filters and lambdas above them, which
    repeats a costly expression at every use.  A generator of one row is a border
    the optimizer does not move expressions across, and it costs no shuffle.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def small_table(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A literal table whose few bytes the optimizer knows, so joins with it need no
    shuffle."""
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))
