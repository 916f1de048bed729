"""Sheet ranges, comparisons and the reference graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions import cells as C

MAX_DEPTH = 64


def typed_cells(cells: DataFrame) -> DataFrame:
    """Non-empty cells with their typed ``value``."""
    return cells.where(F.coalesce(F.col("content"), F.lit("")) != "").withColumn("value", C.typed(F.col("content")))


def cell_range_join(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells inside rectangles ``sheet, range_id, c1, r1, c2, r2`` (ends in any order).

    A range becomes one row per sheet row it covers (at most 99), so the join is on
    sheet and row and only the columns are compared.
    """
    low, high = F.least("r1", "r2"), F.greatest("r1", "r2")
    spread = ranges.select(
        "sheet",
        "range_id",
        F.least("c1", "c2").alias("from_col"),
        F.greatest("c1", "c2").alias("to_col"),
        F.explode(F.sequence(low, high)).alias("row_no"),
    )
    return (
        cells.join(spread, ["sheet", "row_no"])
        .where(F.col("col").between(F.col("from_col"), F.col("to_col")))
        .drop("from_col", "to_col")
    )


def range_aggregate(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """COUNT, SUM, AVG, MIN and MAX of the numbers of each range.

    ``error`` is the first error in row order, which replaces every result;
    ``empty_error`` is ``#VALUE!`` where AVG, MIN and MAX have no number to work on or
    a result is not finite.
    """
    inside = cell_range_join(typed_cells(cells), ranges)
    number = F.when(F.col("value.kind") == "number", F.col("value.num"))
    place = F.struct("row_no", "col")
    wrong = F.col("value.kind") == "error"
    results = inside.groupBy("sheet", "range_id").agg(
        F.count(number).alias("n"),
        F.sum(number).alias("s"),
        F.min(number).alias("lo"),
        F.max(number).alias("hi"),
        F.min_by(F.when(wrong, F.col("value.str")), F.when(wrong, place)).alias("error"),
    )
    whole = ranges.select("sheet", "range_id").join(results, ["sheet", "range_id"], "left")
    fine = F.col("error").isNull()
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    n = F.coalesce("n", F.lit(0))
    total = finite(F.coalesce("s", F.lit(0.0)))
    return whole.select(
        "sheet",
        "range_id",
        F.when(fine, n).alias("count"),
        F.when(fine, total).alias("sum"),
        F.when(fine, finite(F.col("s") / F.col("n"))).alias("avg"),
        F.when(fine, finite(F.col("lo"))).alias("min"),
        F.when(fine, finite(F.col("hi"))).alias("max"),
        "error",
        F.when(fine & ((n == 0) | total.isNull()), "#VALUE!").alias("empty_error"),
    )


def range_logic(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """AND and OR over each range as text: TRUE, FALSE or the error met first.

    Cells count in row order up to the first one that decides, so an error matters
    only in front of it.
    """
    inside = cell_range_join(typed_cells(cells), ranges)
    value, place = F.col("value"), F.struct("row_no", "col")
    wrong = value["kind"] == "error"
    yes = C.truth(value)
    seen = inside.groupBy("sheet", "range_id").agg(
        F.min(F.when(wrong, F.struct("row_no", "col", value["str"].alias("text")))).alias("error"),
        F.min(F.when(~wrong & ~yes, place)).alias("no_at"),
        F.min(F.when(~wrong & yes, place)).alias("yes_at"),
    )
    error_at = F.when(F.col("error").isNotNull(), F.struct(F.col("error.row_no"), F.col("error.col")))

    def decided(at: Column, answer: str, neutral: str) -> Column:
        first = at.isNotNull() & (error_at.isNull() | (at < error_at))
        return F.when(first, answer).when(error_at.isNotNull(), F.col("error.text")).otherwise(neutral)

    return ranges.select("sheet", "range_id").join(seen, ["sheet", "range_id"], "left").select(
        "sheet",
        "range_id",
        decided(F.col("no_at"), "FALSE", "TRUE").alias("all_true"),
        decided(F.col("yes_at"), "TRUE", "FALSE").alias("any_true"),
    )


def reference_edges(formulas: DataFrame) -> DataFrame:
    """``sheet, col, row_no, to_col, to_row`` for every reference of a formula, once each.

    A cell given once, or always with the same formula, needs no table of the edges seen: its own
    list of targets is made distinct.  Only edges of cells with several formulas are compared.
    """
    cell = ["sheet", "col", "row_no"]
    named = formulas.where(F.col("formula").startswith("=")).select(*cell, "formula")

    def edges(rows: DataFrame) -> DataFrame:
        targets = F.array_distinct(F.transform(C.references_in(F.col("formula")), lambda t: C.reference(t)))
        return rows.select(*cell, F.explode(targets).alias("t")).select(
            *cell, F.col("t.col").alias("to_col"), F.col("t.row_no").alias("to_row")
        )

    low, high = F.min("formula"), F.max("formula")
    same = named.groupBy(*cell).agg(low.alias("formula"), high.alias("high")).where("formula = high")
    whole = Window.partitionBy(*cell)
    several = named.withColumns({"low": low.over(whole), "high": high.over(whole)}).where("low < high")
    return edges(same).unionByName(edges(several).distinct())


#: Formula cells settled at once; a batch ends between two sheets.
GRAPH_ROWS = 1 << 16


def _peel(count: int, users: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Depth of every node from its leaves, 0 for nodes that reach a loop.

    Edge ``i`` says that node ``users[i]`` refers to ``used[i]``.  Each round removes the nodes
    whose references are all settled, which is the whole frontier at once.
    """
    waiting = np.bincount(users, minlength=count)
    by_used = np.argsort(used, kind="stable")
    first = np.searchsorted(used[by_used], np.arange(count + 1))
    users = users[by_used]
    depth = np.zeros(count, np.int32)
    frontier, level = np.flatnonzero(waiting == 0), 0
    while len(frontier):
        level += 1
        depth[frontier] = level
        sizes = first[frontier + 1] - first[frontier]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[frontier], sizes)
        touched, times = np.unique(users[at], return_counts=True)
        waiting[touched] -= times
        frontier = touched[waiting[touched] == 0]
    return depth


def _settle(table: pa.Table, limit: int) -> pa.Table:
    """Depths and states of whole sheets, all in one pass."""
    rows = table.num_rows
    sheet = np.asarray(table.column("sheet").combine_chunks().dictionary_encode(null_encoding="encode").indices)
    col, row = (table.column(c).to_numpy().astype(np.int64) for c in ("col", "row_no"))
    lists = {c: table.column(c).combine_chunks() for c in ("to_col", "to_row")}
    owner = np.repeat(np.arange(rows), np.asarray(pc.list_value_length(lists["to_col"])))
    to_col, to_row = (np.asarray(pc.fill_null(v.flatten(), -1)).astype(np.int64) for v in lists.values())
    width, height = int(col.max()) + 1, int(row.max()) + 1
    known = (to_col >= 0) & (to_col < width) & (to_row >= 0) & (to_row < height)
    owner, to_col, to_row = owner[known], to_col[known], to_row[known]
    cell = (sheet.astype(np.int64) * width + col) * height + row
    order = np.argsort(cell, kind="stable")
    wanted = (sheet[owner].astype(np.int64) * width + to_col) * height + to_row
    at = np.searchsorted(cell[order], wanted, "right") - 1  # of cells given twice, the last
    found = (at >= 0) & (cell[order][at] == wanted)
    edges = np.unique(owner[found] * rows + order[at[found]])
    depth = _peel(rows, edges // rows, edges % rows)
    fine = (depth > 0) & (depth <= limit)
    state = np.where(depth == 0, "cycle", np.where(fine, "ok", "too_deep"))
    kept = [table.column(c) for c in ("sheet", "col", "row_no")]
    return pa.Table.from_arrays(
        [*kept, pa.array(depth, mask=~fine), pa.array(state, pa.string())], ["sheet", "col", "row_no", "depth", "state"]
    )


def reference_graph(formulas: DataFrame, limit: int = MAX_DEPTH) -> DataFrame:
    """``sheet, col, row_no, depth, state`` of every formula cell.

    Depth 1 refers to no other formula.  ``state`` is ``ok``, ``cycle`` (the cell
    reaches a loop) or ``too_deep`` (deeper than ``limit``).  References stay inside a sheet and
    a sheet is bounded by its grammar (702 columns, 99 rows), so sheets are sorted together and
    settled from their leaves upwards, many in one batch of arrays.
    """
    targets = F.transform(F.array_distinct(C.references_in(F.col("formula"))), lambda t: C.reference(t))
    cells = formulas.where(F.col("formula").startswith("=")).select(
        "sheet",
        "col",
        "row_no",
        F.transform(targets, lambda t: t["col"].cast("bigint")).alias("to_col"),
        F.transform(targets, lambda t: t["row_no"].cast("bigint")).alias("to_row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < GRAPH_ROWS:
                continue
            table = pa.concat_tables(held).combine_chunks()
            numbers = np.asarray(table.column("sheet").combine_chunks().dictionary_encode(null_encoding="encode").indices)
            last = int(np.flatnonzero(numbers == numbers[-1])[0])
            if last:  # the last sheet may go on in the next batch
                yield from _settle(table.slice(0, last), limit).to_batches()
            held, size = [table.slice(last)], table.num_rows - last
        if size:
            yield from _settle(pa.concat_tables(held).combine_chunks(), limit).to_batches()

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in ("sheet", "col", "row_no"))
    return cells.repartition("sheet").sortWithinPartitions("sheet").mapInArrow(run, f"{kinds}, depth int, state string")
