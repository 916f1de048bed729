"""Tables written to the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import fresh_dir, remove_dir

#: Most rows of a small table (one per language, source or file) that is broadcast.
SMALL_ROWS = 100_000


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write the rows to a new shared folder and read them back."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of jobs run within hold about ``size`` bytes, not Spark's 10,000 rows of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Remove the folders of written tables that nothing reads any more."""
    for df in tables:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            remove_dir(df.sparkSession, path)


def join_small(big: DataFrame, small: DataFrame, on: Column) -> DataFrame:
    """Left join with a table that is usually small: it is counted, and broadcast only
    up to ``SMALL_ROWS`` rows; beyond that both sides are shuffled."""
    few = small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return big.join(F.broadcast(small) if few else small, on, "left")


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spot_of(column: str, bits: int) -> Column:
    """The bit of a ``2**bits`` bitmap that a value falls on."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def bitmap(values: DataFrame, column: str, bits: int, hashed: bool = True) -> np.ndarray:
    """The values' spots in a bitmap of fixed size; a chance hit must do no harm where it is used.

    ``hashed=False`` takes the column itself as the spot."""
    one = F.expr("shiftleft(1L, cast(pmod(spot, 64) AS int))")
    rows = values.select((spot_of(column, bits) if hashed else F.col(column)).alias("spot"))
    found = rows.groupBy(F.floor(F.col("spot") / 64).alias("cell")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return out


def in_bitmap(found: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return ((found[spot >> 6] >> (spot & 63)) & 1).astype(bool)
