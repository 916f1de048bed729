"""Connected components by alternating stars; the graph never leaves the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.shared import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.where("b > a").join(least, "a")
    return linked.select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    linked = down.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    out = linked.unionByName(least.select("x", F.col("m").alias("y")))
    return out.where("x <> y").select(F.col("y").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``doc_id, component`` of every node of the edges ``a, b``; a component's id is its least node.

    Each round shortens paths by a constant factor; rounds are written, so lost executors cost one
    round.  It ends when all edges are stars: no node is both centre and leaf, or leaf of two.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "cc")
    while True:
        ends = now.select(F.inline(F.array(_end("a", None), _end("b", "a"))))
        mixed = ends.groupBy("x").agg(F.max("leaf").alias("leaf"), F.min("leaf").alias("centre"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        if mixed.where("leaf = 1 AND (centre = 0 OR lo < hi)").isEmpty():
            break
        before, now = now, written(_small_star(_large_star(now)), "cc")
        discard(before)
    roots = now.select(F.col("a").alias("doc_id"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("doc_id"), F.col("a").alias("component")).distinct().unionByName(roots)


def _end(node: str, centre: str | None) -> Column:
    at = F.col(centre) if centre else F.lit(None).cast("bigint")
    return F.struct(F.col(node).alias("x"), F.lit(int(centre is not None)).alias("leaf"), at.alias("at"))
