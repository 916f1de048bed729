"""Inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary, by default that of op10; a file of the driver, read there once."""
    import public_tokenizers

    return public_tokenizers.path(name)
