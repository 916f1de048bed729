"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.operators.ordered import number_rows
from opslens.operators.staging import once

#: Hash bits per (key, shard): 13 hex digits, exact in a double; one digest serves two shards.
DIGITS = 13
#: Hex digits of the numbered blocks of a shard (4096 blocks), so that no task sorts a whole shard.
BLOCK_DIGITS = 3


def key_text(*columns: Column) -> Column:
    """A stable text of the key columns: length-prefixed parts, ``~`` for null."""
    shown = [c.cast("string") for c in columns]
    if len(shown) == 1:
        return F.coalesce(shown[0], F.lit("~"))
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit("="), c), F.lit("~")) for c in shown]
    return F.concat_ws(":", *parts)


def _costs(digests: Column, weights: Sequence[float]) -> Column:
    """``struct(cost, shard)`` per shard: -ln(u) / weight, u in (0, 1) from the digest."""
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def cost(entry: Column) -> Column:
        digest = F.element_at(digests, (F.floor(entry["shard"] / 2) + 1).cast("int"))
        bits = F.conv(digest.substr(F.lit(1) + (entry["shard"] % 2) * DIGITS, F.lit(DIGITS)), 16, 10).cast("double")
        return F.struct(
            (-F.log((bits + 0.5) / float(16**DIGITS)) / entry["weight"]).alias("cost"), entry["shard"].alias("shard")
        )

    return F.transform(shards, cost)


def assign(
    df: DataFrame, key: Column, weights: Sequence[float], name: str = "shard", grown: str | None = None, extra: float = 1.0
) -> DataFrame:
    """Add ``name``: the shard with the least cost for the row's key.

    Key and weights alone decide, so equal keys share a shard and an added shard of
    weight ``extra`` takes rows only into itself (``grown`` names that column).  A null
    key is a key of its own.  Rows are neither dropped nor moved: it is one projection.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    count = len(weights) + (grown is not None)
    digests = F.transform(
        F.sequence(F.lit(0), F.lit((count + 1) // 2 - 1)),
        lambda g: F.md5(F.concat(key, F.lit("#"), g.cast("string")).cast("binary")),
    )
    kept = [c for c in df.columns if c not in {name, grown}]
    rows = once(df, __digests=digests)
    rows = once(rows, __costs=_costs(F.col("__digests"), [*weights, extra] if grown else weights))
    chosen = {name: F.array_min(F.slice("__costs", 1, len(weights)))["shard"].cast("int")}
    if grown:
        chosen[grown] = F.array_min("__costs")["shard"].cast("int")
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in chosen.items()])


def number_slots(df: DataFrame, order: Sequence[str], shard: str = "shard", name: str = "slot") -> DataFrame:
    """Add ``name``: the row's gapless place from 0 in its shard.

    Rows are ordered by a hashed block of their ``order`` columns, then by these;
    blocks are numbered one by one and shifted by the sizes of the blocks before.
    Equal rows take neighbouring places.
    """
    digest = F.md5(F.concat(key_text(*[F.col(c) for c in order]), F.lit("#slot")).cast("binary"))
    blocked = df.withColumn("__block", F.substring(digest, 1, BLOCK_DIGITS))
    out = number_rows(blocked, [shard], "__block", list(order), name)
    return out.withColumn(name, F.col(name) - 1).drop("__block")


def shard_documents(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None) -> DataFrame:
    """Size, checksum, shard and place of every document.

    A null text has no bytes (size 16, checksum 0); a null id is one key.  Repeated rows
    are kept, share a shard and get places of their own; an empty table gives no rows.
    Only narrow columns are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
    )
    placed = assign(rows, key_text(F.col("doc_id")), weights or [1.0] * shards, "shard", "grown_shard")
    slots = number_slots(placed, ["doc_id", "text_crc32", "size"])
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        "grown_shard",
    )


def write_sharded(df: DataFrame, path: str, key: Column, weights: Sequence[float]) -> None:
    """Write the rows as one folder per shard (``shard=N``), keeping every column."""
    assign(df, key, weights).write.partitionBy("shard").parquet(path)
