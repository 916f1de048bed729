"""Scan rules given as a table: millions of patterns without trying each on every line.

A pattern's matches all hold one of a few literals.  The rules with the shortest literals, which lines
hold most often, go to all tasks: an Aho-Corasick automaton over their literals finds, in one
pass over a line, the few of them that can match it.  All others are joined with the lines on the
last bytes of their literals (*seeds*); a bitmap of the seeds keeps lines without one
from the shuffle.  Only the rules found are tried, by Spark's own ``RLIKE``.  Rules without a literal
are tried on every line.
"""

from __future__ import annotations

import re
import warnings
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions import code as C
from opslens.operators.staging import stored

#: Rules of the automaton; so many rules without a literal are tried in one pass.
BLOCK_RULES = 50_000
#: A seed has so many bytes at most, which two numbers of 64 bits hold.
SEED_BYTES = 16
#: Bytes of lines that are looked through at once.
CUT_BYTES = 1 << 20
#: The bitmap of seeds has 16 bits a rule, up to 2 to this power.
SEED_BITS = 28
_PARTS = re._parser
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _nested_class(pattern: str) -> bool:
    """Whether a character class holds another one or an intersection, which is read differently here."""
    inside, i = False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if inside and (c == "[" or pattern.startswith("&&", i)):
            return True
        if c == "[":
            inside = True
            i += 1 + pattern.startswith("^", i + 1)
            i += pattern.startswith("]", i)
            continue
        if c == "]":
            inside = False
        i += 1
    return False


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """Of two sets of literals, the one whose shortest is longer."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


def _required(items) -> list[str] | None:
    best, run = None, ""
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):  # no characters of their own
            continue
        best, run, found = _better(best, [run] if run else None), "", None
        if name == "SUBPATTERN":
            found = _required(value[3])
        elif name == "ATOMIC_GROUP":
            found = _required(value)
        elif name == "BRANCH":
            ways = [_required(way) for way in value[1]]
            found = None if None in ways else [x for way in ways for x in way]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            found = _required(value[2])
        best = _better(best, found)
    return _better(best, [run] if run else None)


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match holds one, or none where that is not known."""
    if _nested_class(pattern) or re.search(r"\(\?[a-zA-Z-]*[uUx]", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            found = _required(_PARTS.parse(pattern))
    except (re.error, Warning, RecursionError, OverflowError):
        return None  # a pattern of Spark's dialect only
    # other letters have other lower cases
    return None if found is None else sorted({x.translate(_LOWER) for x in found})


def _automaton(literals: dict[str, list[int]]):
    import ahocorasick

    words = ahocorasick.Automaton()
    for text, numbers in literals.items():
        words.add_word(text, numbers)
    words.make_automaton()
    return words


def rule_table_scan(lines: DataFrame, table: DataFrame) -> DataFrame:
    """One row per rule and line, as ``red_flag_scan`` gives: ``path, line_no, rule, snippet``.

    ``table`` holds ``rule, pattern`` and, if wanted, ``header_only``.  Rules without a name or pattern are left out;
    a rule given twice is found twice.  The literals of the rules are found in tasks and written while the plan
    is built.  Lines are read once for the automaton and once for the join, however many rules there are;
    rules without a literal are read in blocks of ``BLOCK_RULES``.
    """
    spark = lines.sparkSession
    header_only = F.coalesce(F.col("header_only"), F.lit(False)) if "header_only" in table.columns else F.lit(False)
    rows = table.where("rule IS NOT NULL AND pattern IS NOT NULL").select("rule", "pattern", header_only.alias("header_only"))
    kinds = "rule string, pattern string, header_only boolean, literals array<string>, shortest int"
    dealt = rows.repartition(spark.sparkContext.defaultParallelism, "pattern", "rule")
    known = stored(dealt.mapInArrow(_with_literals, kinds), "rules")
    sizes = sorted(tuple(r) for r in known.groupBy("shortest").count().collect())
    limit = reached = 0
    for shortest, count in sizes:
        reached += count if shortest else 0
        if reached > BLOCK_RULES:
            break
        limit = shortest
    parts, block = [], []
    if sizes and not sizes[0][0]:
        for row in known.where("shortest = 0").toLocalIterator():
            block.append((row["rule"], row["pattern"], row["header_only"]))
            if len(block) == BLOCK_RULES:
                parts, block = [*parts, _tried(lines, block)], []
        if block:
            parts.append(_tried(lines, block))
    if limit:
        near = known.where(f"shortest BETWEEN 1 AND {limit}").select("rule", "pattern", "header_only", "literals")
        parts.append(_found(lines, spark.sparkContext.broadcast([tuple(r) for r in near.collect()])))
    if reached > BLOCK_RULES:
        parts.append(_met(lines, known.where(F.col("shortest") > limit)))
    if not parts:
        return _tried(lines, [])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _with_literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules with their literals and the bytes of the shortest, 0 where none is known."""
    for batch in batches:
        found = [required_literals(pattern) or [] for pattern in batch.column("pattern").to_pylist()]
        shortest = [min((len(x.encode()) for x in texts), default=0) for texts in found]
        columns = [*batch.columns, pa.array(found, pa.list_(pa.string())), pa.array(shortest, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "literals", "shortest"])


def _packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number; beyond the end there are zeros."""
    out = data.astype(np.uint64)
    for size in (1, 2, 4):
        out[:-size] |= out[size:] << np.uint64(8 * size)
    return out


def _seeds(packed: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name of the ``size`` bytes from each place; equal bytes have equal names."""
    if size < 8:
        name = packed & np.uint64((1 << 8 * size) - 1)
    else:
        name = packed * np.uint64(0x9E3779B97F4A7C15)
        name[: len(name) - (size - 8)] += packed[size - 8 :]
    name = (name ^ np.uint64(size << 57)) * np.uint64(0xBF58476D1CE4E5B9)
    name = (name ^ (name >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (name ^ (name >> np.uint64(32))).view(np.int64)


def _in_bitmap(held: np.ndarray, names: np.ndarray, bits: int) -> np.ndarray:
    """Whether both bits of each name are set."""
    low = np.int64((1 << bits) - 1)
    first, second = names & low, (names >> np.int64(64 - bits - 1)) & low
    out = (held[first >> 3] >> (first & 7).astype(np.uint8)) & 1
    return (out & (held[second >> 3] >> (second & 7).astype(np.uint8))).astype(bool)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """The seeds' bits: cells of 64 bits are merged by Spark, only the bitmap itself is collected."""
    low = (1 << bits) - 1
    spots = F.array(F.col("seed").bitwiseAND(F.lit(low)), F.shiftright("seed", 64 - bits - 1).bitwiseAND(F.lit(low)))
    one = F.expr("shiftleft(1L, cast(spot & 63 AS int))")
    cells = seeds.select(F.explode(spots).alias("spot")).groupBy(F.shiftright("spot", 6).alias("cell"))
    found = cells.agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _with_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules with the names of the last bytes of their literals, and the sizes of these."""
    for batch in batches:
        names, sizes = [], []
        for texts in batch.column("literals").to_pylist():
            tails = {x.encode()[-SEED_BYTES:] for x in texts}
            names.append(sorted({int(_seeds(_packed(np.frombuffer(x, np.uint8)), len(x))[0]) for x in tails}))
            sizes.append(sorted({len(x) for x in tails}))
        columns = [*(batch.column(c) for c in ("rule", "pattern", "header_only")), *(pa.array(x, pa.list_(pa.int64())) for x in (names, sizes))]
        yield pa.RecordBatch.from_arrays(columns, ["rule", "pattern", "header_only", "seeds", "sizes"])


def _met(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules joined with the lines that hold one of their seeds.

    A line travels once for each seed it holds, with all of them, so that a rule with several literals is
    tried where the first of its seeds meets the line.
    """
    kinds = "rule string, pattern string, header_only boolean, seeds array<bigint>, sizes array<bigint>"
    rules = stored(rules.mapInArrow(_with_seeds, kinds), "seeds")
    dealt = rules.select("rule", "pattern", "header_only", "seeds", F.explode("seeds").alias("seed"))
    sizes = [r[0] for r in rules.select(F.explode("sizes")).distinct().collect()]
    bits = min(SEED_BITS, max(10, (16 * dealt.count()).bit_length()))
    sent = lines.sparkSession.sparkContext.broadcast(_bitmap(dealt, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            texts = batch.column("stripped").fill_null("")
            ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy()))
            data = np.frombuffer("".join(texts.to_pylist()).translate(_LOWER).encode(), np.uint8) if ends[-1] else np.zeros(0, np.uint8)
            rows, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start in range(0, len(data), CUT_BYTES):
                packed = _packed(data[start : start + CUT_BYTES + SEED_BYTES])
                for size in sizes:
                    if size > len(packed):
                        continue
                    names = _seeds(packed, size)[:CUT_BYTES]
                    at = np.flatnonzero(_in_bitmap(held, names, bits))
                    inside = np.searchsorted(ends, start + at, "right") - 1
                    whole = start + at + size <= ends[inside + 1]
                    rows.append(inside[whole])
                    seeds.append(names[at[whole]])
            row, seed = np.concatenate(rows), np.concatenate(seeds)
            order = np.lexsort((seed, row))
            row, seed = row[order], seed[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
            row, seed = row[new], seed[new]
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(seed, pa.int64()))
            kept = batch.take(pa.array(row))
            columns = [*kept.columns, pa.array(seed, pa.int64()), lists.take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "seed", "met"])

    names = ("path", "line_no", "raw", "stripped", "is_header")
    form = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in names)
    held = lines.select(*names).mapInArrow(run, f"{form}, seed bigint, met array<bigint>")
    first = F.element_at(F.array_intersect("seeds", "met"), 1) == F.col("seed")
    tried = held.join(dealt, "seed").where((~F.col("header_only") | F.col("is_header")) & first)
    return tried.where(F.rlike("stripped", F.col("pattern"))).select(
        "path", "line_no", "rule", C.snippet(F.col("raw")).alias("snippet")
    )


def _tried(lines: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """Rules tried on every line, as literals of one projection."""
    stripped = F.col("stripped")
    none = F.array().cast("array<string>")
    every = [(rule, pattern) for rule, pattern, header in rules if not header]
    headers = [(rule, pattern) for rule, pattern, header in rules if header]
    found = C.matching(stripped, every) if every else none
    if headers:
        found = F.when(F.col("is_header"), F.concat(found, C.matching(stripped, headers))).otherwise(found)
    return lines.select("path", "line_no", F.explode(found).alias("rule"), C.snippet(F.col("raw")).alias("snippet"))


def _found(lines: DataFrame, rules) -> DataFrame:
    """Rules whose literals a line holds, each tried on that line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rules.value
        literals: dict[str, list[int]] = defaultdict(list)
        for number, (_, _, _, texts) in enumerate(table):
            for text in texts:
                literals[text].append(number)
        words = _automaton(literals)
        for batch in batches:
            coded = batch.column("stripped").dictionary_encode()
            offered = []
            for text in coded.dictionary.to_pylist():
                held = set()
                for _, numbers in words.iter(text.translate(_LOWER)):
                    held.update(numbers)
                offered.append(sorted(held))
            at, found = [], []
            headers = batch.column("is_header").to_pylist()
            for row, code in enumerate(coded.indices.to_pylist()):
                for number in offered[code] if code is not None else ():
                    if headers[row] or not table[number][2]:
                        at.append(row)
                        found.append(number)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(kept.column(c) for c in ("path", "line_no", "raw", "stripped")),
                    pa.array([table[n][0] for n in found], pa.string()),
                    pa.array([table[n][1] for n in found], pa.string()),
                ],
                ["path", "line_no", "raw", "stripped", "rule", "pattern"],
            )

    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("path", "line_no", "raw", "stripped"))
    offered = lines.select("path", "line_no", "raw", "stripped", "is_header").mapInArrow(run, f"{kinds}, rule string, pattern string")
    return offered.where(F.rlike("stripped", F.col("pattern"))).select(
        "path", "line_no", "rule", C.snippet(F.col("raw")).alias("snippet")
    )
