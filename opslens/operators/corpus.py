"""Source corpus operators.

A file is one row, as file readers deliver it, so everything a file needs from
its own neighbouring lines is prepared inside that row and costs no shuffle.
Windows by ``path`` therefore never hold more than one file.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens import rules
from opslens.functions import code as C
from opslens.functions import text as T
from opslens.operators.ruletable import rule_table_scan
from opslens.operators.staging import once, small_table, stored
from opslens.session import fresh_dir
from opslens.sources.readers import HEADER_EXTENSIONS, extension

_PRINTF_CALL = re.compile(rules.PRINTF_CALL, re.ASCII)
_SIZE_ARGUMENT = re.compile(rules.SIZE_ARGUMENT, re.ASCII)
_INT_CONVERSION = re.compile(rules.INT_CONVERSION, re.ASCII)


def is_header(path: Column) -> Column:
    return extension(path).isin(*HEADER_EXTENSIONS)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*\z", ""))


def explode_code_lines(corpus: DataFrame) -> DataFrame:
    """One row per line: ``path, line_no, raw, stripped, is_header, loc``, the next
    stripped line, and whether the line counts as output text (it or one of the
    three lines before it prints something)."""
    return _exploded(corpus.select("path", "text"))


def _exploded(corpus: DataFrame, *facts: str, whole: bool = False) -> DataFrame:
    """Lines with some columns of their files; ``whole`` keeps a file without lines as a row
    without a line number."""
    prints = F.transform(
        C.split_lines(F.col("text")),
        lambda l: F.contains(T.ascii_lower(l), F.lit("printf"))
        | F.contains(l, F.lit("<<"))
        | (F.contains(T.ascii_lower(l), F.lit("log")) & F.contains(l, F.lit('"'))),
    )
    files = once(
        corpus,
        raw=C.split_lines(F.col("text")),
        stripped=C.split_lines(C.strip_comments(F.col("text"))),
        prints=prints,
    )
    no = F.lit(False)
    zipped = F.arrays_zip(
        F.col("raw"),
        F.col("stripped"),
        C.shifted(F.col("stripped"), -1, F.lit(None).cast("string")).alias("next_stripped"),
        F.col("prints").alias("p0"),
        *[C.shifted(F.col("prints"), k, no).alias(f"p{k}") for k in (1, 2, 3)],
    )
    explode = F.posexplode_outer if whole else F.posexplode
    rows = files.select(
        "path", *facts, is_header(F.col("path")).alias("is_header"), F.size("raw").cast("bigint").alias("loc"),
        explode(zipped).alias("pos", "l"),
    )
    return rows.select(
        "path",
        *facts,
        (F.col("pos") + 1).cast("bigint").alias("line_no"),
        F.col("l.raw").alias("raw"),
        F.col("l.stripped").alias("stripped"),
        "is_header",
        "loc",
        F.col("l.next_stripped").alias("next_stripped"),
        (F.col("l.p0") | F.col("l.p1") | F.col("l.p2") | F.col("l.p3")).alias("output_like"),
    )


def scan_lines(corpus: DataFrame) -> DataFrame:
    """The lines of a scan, written once, for all sections that read them: as
    :func:`explode_code_lines`, with the file's ``guard_rule``; an empty file is one row without
    a line number."""
    marked = once(corpus.select("path", "text"), guard_rule=_guard_rule())
    return stored(_exploded(marked, "guard_rule", whole=True), "scan-lines")


# --- line rules -------------------------------------------------------------------


def todo_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("raw").rlike(rules.TODO)).select("path", "line_no", C.snippet(F.col("raw")).alias("snippet"))


def red_flag_scan(
    lines: DataFrame,
    flags: list[tuple[str, str]] | DataFrame | None = None,
    header_flags: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per rule and line: ``path, line_no, rule, snippet``.

    Rules are literals of one projection, so each pattern compiles once and the
    lines are read once.  A table of rules (``rule, pattern, header_only``) may be of any size and
    goes through an automaton of its literals.
    """
    if isinstance(flags, DataFrame):
        return rule_table_scan(lines, flags)
    stripped = F.col("stripped")
    every = C.matching(stripped, rules.RED_FLAGS if flags is None else flags)
    headers = C.matching(stripped, rules.HEADER_ONLY_FLAGS if header_flags is None else header_flags)
    found = F.when(F.col("is_header"), F.concat(every, headers)).otherwise(every)
    return lines.select("path", "line_no", F.explode(found).alias("rule"), C.snippet(F.col("raw")).alias("snippet"))


def reach_out_includes(lines: DataFrame) -> DataFrame:
    """Include lines of headers that leave their folder; raw text, since stripping
    blanks the path."""
    raw = F.col("raw")
    return lines.where(F.col("is_header") & raw.rlike(rules.INCLUDE) & F.contains(raw, F.lit('"../'))).select(
        "path", "line_no", F.lit(rules.REACH_OUT_FLAG).alias("rule"), C.snippet(raw).alias("snippet")
    )


def _closing(line: str) -> dict[int, int]:
    """Place of the parenthesis that closes each one that is closed, in one pass."""
    waiting, found = [], {}
    for mark in re.finditer(r"[()]", line):
        if mark.group() == "(":
            waiting.append(mark.start())
        elif waiting:
            found[waiting.pop()] = mark.start()
    return found


def _prints_size_badly(line: str) -> bool:
    """Whether some printing call of a line prints a size-like argument after its last literal
    without ``%z``.

    A call starts where the pattern matches and opens a parenthesis with its last character; one
    that stays open has no text.  All marks of the line are found once and each call looks up its
    own, so the work grows with the line and not with the length of its calls.
    """
    closing = _closing(line)
    quotes = [m.start() for m in re.finditer('"', line)]
    sizes = [m.span() for m in _SIZE_ARGUMENT.finditer(line)]
    size_starts = [s for s, _ in sizes]
    casts = [m.start() for m in re.finditer("static_cast<", line)]
    bare: dict[int, bool] = {}  # by the quote that opens a literal

    def first(starts: list[int], low: int) -> int:
        return bisect.bisect_left(starts, low)

    for call in _PRINTF_CALL.finditer(line):
        low = call.end() - 1
        if low not in closing:
            continue
        high = closing[low] + 1
        opening, after = first(quotes, low), first(quotes, high)
        if after - opening < 2:
            continue
        last = opening + (after - opening) // 2 * 2 - 1  # closes the last literal
        behind = quotes[last] + 1
        size = first(size_starts, behind)
        if size == len(sizes) or sizes[size][1] > high:
            continue
        cast = first(casts, behind)
        if cast < len(casts) and casts[cast] + len("static_cast<") <= high:
            continue
        if last - 1 not in bare:
            text = line[quotes[last - 1] + 1 : quotes[last]]
            bare[last - 1] = any(m.group(1) == "" for m in _INT_CONVERSION.finditer(text))
        if bare[last - 1]:
            return True
    return False


def printf_spec_scan(lines: DataFrame) -> DataFrame:
    """Lines that print a size-like argument after the last literal without ``%z``.

    Balanced parentheses are not regular, so lines that may be meant, by three patterns, are
    judged by a small function in Arrow batches.
    """

    @F.pandas_udf("boolean")
    def badly(raw: pd.Series) -> pd.Series:
        return raw.map(_prints_size_badly).astype(bool)

    raw = F.col("raw")
    likely = raw.rlike(rules.PRINTF_CALL) & raw.rlike(rules.SIZE_ARGUMENT) & F.contains(raw, F.lit("%"))
    return (
        lines.where(likely)
        .select("path", "line_no", "raw")
        .where(badly("raw"))
        .select("path", "line_no", F.lit(rules.PRINTF_FLAG).alias("rule"), C.snippet(raw).alias("snippet"))
    )


def hit_totals(hits: DataFrame, samples: int = 3) -> DataFrame:
    """``rule, hits, files, samples`` of ``path, line_no, rule, snippet`` rows; samples
    are the first by path and line, joined by newlines."""
    per_file = hits.groupBy("rule", "path").agg(F.count(F.lit(1)).alias("n"))
    counted = per_file.groupBy("rule").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("files"))
    order = Window.partitionBy("rule").orderBy("path", "line_no")
    text = F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit("  "), F.col("snippet"))
    first = (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= samples)
        .groupBy("rule")
        .agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))).alias("kept"))
        .select("rule", F.array_join(F.col("kept.text"), "\n").alias("samples"))
    )
    return counted.join(first, "rule")


# --- headers ------------------------------------------------------------------------


def _guard_rule() -> Column:
    once = F.contains("text", F.lit("#pragma once"))
    guard = F.col("text").rlike(rules.GUARD)
    wrong = F.when(~once & ~guard, "header missing include guard").when(guard & ~once, "#ifdef guard (no #pragma once)")
    return F.when(is_header(F.col("path")), wrong)


def guard_style(corpus: DataFrame) -> DataFrame:
    """Headers without an include guard, or with an ``#ifndef`` guard only."""
    return corpus.where(is_header(F.col("path"))).select("path", _guard_rule().alias("rule")).where(F.col("rule").isNotNull())


def code_before_include(lines: DataFrame) -> DataFrame:
    """First code line of a header, when an include follows it."""
    code = F.btrim("stripped", F.lit(" \t\r\n\f\u000b"))
    is_code = (code != "") & ~code.startswith("#")
    first = lines.where("is_header").groupBy("path").agg(
        F.min(F.when(F.col("raw").rlike(rules.INCLUDE), F.col("line_no"))).alias("include"),
        F.min(F.when(is_code, F.struct("line_no", "raw"))).alias("code"),
    )
    return first.where(F.col("code.line_no") < F.col("include")).select(
        "path",
        F.col("code.line_no").alias("line_no"),
        F.lit("code before first include").alias("rule"),
        C.snippet(F.col("code.raw"), 80).alias("snippet"),
    )


def unsorted_includes(lines: DataFrame) -> DataFrame:
    """First out-of-order include of each run of consecutive include lines of a header."""
    bracket, target = C.include_target(F.col("raw"))
    includes = lines.where(F.col("is_header") & F.col("raw").rlike(rules.INCLUDE)).select(
        "path", "line_no", "raw", bracket.alias("bracket"), F.lower(target).alias("target")
    )
    order = Window.partitionBy("path").orderBy("line_no")
    before = F.lag(F.struct("line_no", "bracket", "target")).over(order)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = includes.withColumn("before", before)
    starts = F.col("before").isNull() | (F.col("before.line_no") != F.col("line_no") - 1)
    runs = linked.withColumn("run", F.last(F.when(starts, F.col("line_no")), ignorenulls=True).over(upto))
    wrong = (
        ~starts
        & (F.col("bracket") != "")
        & (F.col("bracket") == F.col("before.bracket"))
        & (F.col("target") < F.col("before.target"))
    )
    return (
        runs.where(wrong)
        .groupBy("path", "run")
        .agg(F.min(F.struct("line_no", "raw")).alias("first"))
        .select(
            "path",
            F.col("first.line_no").alias("line_no"),
            F.lit("unsorted includes").alias("rule"),
            C.snippet(F.col("first.raw"), 80).alias("snippet"),
        )
    )


def self_header_first(corpus: DataFrame) -> DataFrame:
    """Source files whose same-named header exists but is not their first include."""
    includes = F.filter(C.split_lines(F.col("text")), lambda l: l.rlike(rules.INCLUDE))
    return _own_header_first(corpus.select("path", F.get(includes, F.lit(0)).alias("first")))


def _own_header_first(files: DataFrame) -> DataFrame:
    """:func:`self_header_first` over files and their ``first`` include line."""
    named = files.select(
        "path",
        stem(F.col("path")).alias("stem"),
        is_header(F.col("path")).alias("is_header"),
        "first",
    )
    headers = named.where("is_header").select("stem").distinct()
    _, target = C.include_target(F.col("first"))
    base = F.element_at(F.split(F.replace(target, F.lit("\\"), F.lit("/")), "/"), -1)
    included = F.lower(F.regexp_replace(base, r"\.[^.]*\z", ""))
    return (
        named.where(~F.col("is_header"))
        .join(headers, "stem", "left_semi")
        .where((target != "") & (included != F.col("stem")))
        .select("path", target.alias("first_include"))
    )


def header_hygiene(corpus: DataFrame, lines: DataFrame) -> DataFrame:
    """All header findings as ``path, line_no, rule, snippet`` (line 0: whole file)."""
    return _hygiene(guard_style(corpus), self_header_first(corpus), lines)


def _hygiene(guards: DataFrame, own: DataFrame, lines: DataFrame) -> DataFrame:
    whole = guards.select("path", F.lit(0).cast("bigint").alias("line_no"), "rule", F.lit("").alias("snippet"))
    own = own.select(
        "path",
        F.lit(0).cast("bigint").alias("line_no"),
        F.lit("self-header not first include").alias("rule"),
        F.concat(F.lit("first include is "), F.col("first_include")).alias("snippet"),
    )
    return (
        whole.unionByName(own).unionByName(code_before_include(lines)).unionByName(unsorted_includes(lines))
    )


def scan_hygiene(scan: DataFrame) -> DataFrame:
    """:func:`header_hygiene` of the lines that :func:`scan_lines` has written."""
    lines = scan.where("line_no IS NOT NULL")
    first = F.min_by("raw", F.when(F.col("raw").rlike(rules.INCLUDE), F.col("line_no")))
    firsts = lines.groupBy("path").agg(first.alias("first"))
    guards = scan.where("coalesce(line_no, 1) = 1 AND guard_rule IS NOT NULL").select("path", F.col("guard_rule").alias("rule"))
    return _hygiene(guards, _own_header_first(firsts), lines)


def header_class_rows(lines: DataFrame) -> DataFrame:
    """Classes and structs defined at column 0 of headers; forward declarations do
    not count."""
    line = F.col("stripped")
    same = F.regexp_extract(line, rules.CLASS_SAME_LINE, 1)
    opened = F.ltrim("next_stripped", F.lit(" \t\r\n\f\u000b")).startswith("{")
    later = F.when(F.coalesce(opened, F.lit(False)), F.regexp_extract(line, rules.CLASS_NEXT_LINE, 1)).otherwise("")
    return (
        lines.where(F.col("is_header") & line.rlike(r"\A\S"))
        .select("path", "line_no", F.when(same != "", same).otherwise(later).alias("name"))
        .where(F.col("name") != "")
    )


def multi_class_headers(classes: DataFrame, least: int = 2) -> DataFrame:
    return (
        classes.groupBy("path")
        .agg(
            F.count(F.lit(1)).alias("classes"),
            F.array_sort(F.collect_list(F.struct("line_no", "name"))).alias("rows"),
        )
        .where(F.col("classes") >= least)
        .select("path", "classes", F.array_join(F.col("rows.name"), ",").alias("names"))
    )


# --- functions ----------------------------------------------------------------------


def function_spans(lines: DataFrame, headers: bool = False) -> DataFrame:
    """``path, start, name, length`` of function-like blocks of three or more lines.

    A block ends at the first line where its braces balance (or at the end of the
    file); blocks inside another are not reported.  Only lines with braces matter:
    each line that lowers the depth closes every level it crosses, so a block's
    end is the next closer of its own level.  All windows share one shuffle.
    """
    source = lines if headers else lines.where(~F.col("is_header"))
    stripped = F.col("stripped")
    braces = source.where(stripped.rlike(r"[{}]")).select(
        "path",
        "line_no",
        "loc",
        C.function_name(stripped).alias("name"),
        C.brace_balance(stripped).cast("bigint").alias("net"),
    )
    by_line = Window.partitionBy("path").orderBy("line_no")
    upto = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = braces.withColumn("after", F.sum("net").over(upto)).withColumn("before", F.col("after") - F.col("net"))
    events = deep.select(
        "path",
        "line_no",
        "loc",
        F.inline(
            F.concat(
                F.when(
                    F.col("name").isNotNull(),
                    F.array(F.struct(F.col("before").alias("level"), F.col("name").alias("opens"), F.col("net").alias("net"))),
                ).otherwise(F.array()),
                F.when(
                    F.col("after") < F.col("before"),
                    F.transform(
                        F.sequence(F.col("after"), F.col("before") - 1),
                        lambda level: F.struct(
                            level.alias("level"), F.lit(None).cast("string").alias("opens"), F.col("net").alias("net")
                        ),
                    ),
                ).otherwise(F.array()),
            )
        ),
    )
    closes = F.when(F.col("opens").isNull(), F.col("line_no"))
    following = (
        Window.partitionBy("path", "level")
        .orderBy(F.col("line_no").desc())
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        events.withColumn("close", F.min(closes).over(following))
        .where(F.col("opens").isNotNull())
        .withColumn(
            "end",
            F.when(F.col("net") <= 0, F.col("line_no")).otherwise(F.coalesce("close", "loc")),
        )
    )
    earlier = by_line.rowsBetween(Window.unboundedPreceding, -1)
    outer = starts.withColumn("covered", F.max("end").over(earlier)).where(
        F.col("covered").isNull() | (F.col("line_no") > F.col("covered"))
    )
    return (
        outer.withColumn("length", F.col("end") - F.col("line_no") + 1)
        .where(F.col("length") >= 3)
        .select("path", F.col("line_no").alias("start"), F.col("opens").alias("name"), "length")
    )


def naming_distribution(spans: DataFrame) -> DataFrame:
    """Functions per naming style; a style is a minority at 25 % of the peak or less."""
    counted = spans.groupBy(C.name_style(F.col("name")).alias("style")).agg(F.count(F.lit(1)).alias("functions"))
    peak = F.max("functions").over(Window.partitionBy(F.lit(0)))
    return counted.withColumn("minority", F.col("functions") * 4 <= peak)


def member_naming_counts(lines: DataFrame) -> DataFrame:
    """Occurrences per member naming rule."""
    counts = lines.agg(
        *[F.sum(F.regexp_count("stripped", F.lit(p))).alias(f"c{i}") for i, (_, p) in enumerate(rules.MEMBER_RULES)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(label).alias("rule"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("bigint").alias("n"))
            for i, (label, _) in enumerate(rules.MEMBER_RULES)
        ]
    )
    return counts.select(F.inline(entries))


def member_naming_samples(lines: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` lines per member naming rule with the name found."""
    found = F.array(
        *[
            F.struct(F.lit(label).alias("rule"), F.regexp_extract("stripped", pattern, 0).alias("name"))
            for label, pattern in rules.MEMBER_RULES
        ]
    )
    named = lines.select("path", "line_no", F.inline(F.filter(found, lambda f: f["name"] != "")))
    order = Window.partitionBy("rule").orderBy("path", "line_no")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("rule", "path", "line_no", "name")


def function_naming_samples(spans: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` functions with their naming style."""
    styled = spans.select("path", "start", "name", C.name_style(F.col("name")).alias("style"))
    return styled.orderBy("path", "start").limit(k)


# --- output text ----------------------------------------------------------------------


def log_field_scan(lines: DataFrame) -> DataFrame:
    """Keys written as ``key=`` or ``key:`` inside literals of output-like lines."""
    literals = lines.where("output_like").select(
        "path", "line_no", F.explode(F.regexp_extract_all("raw", F.lit(rules.QUOTED), F.lit(1))).alias("literal")
    )
    found = literals.select(
        "path", "line_no", F.explode(F.regexp_extract_all("literal", F.lit(rules.LOG_KEY), F.lit(0))).alias("m")
    )
    key = F.regexp_extract("m", r"\A(\w+)", 1)
    return found.select(
        "path", "line_no", key.alias("key"), F.substring("m", -1, 1).alias("separator"), C.name_style(key).alias("style")
    )


def log_field_style(fields: DataFrame) -> DataFrame:
    """Counts per separator and per key style as ``kind, label, n``."""
    labels = F.array(
        F.struct(F.lit("separator").alias("kind"), F.col("separator").alias("label")),
        F.struct(F.lit("style").alias("kind"), F.col("style").alias("label")),
    )
    return fields.select(F.inline(labels)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


def top_log_keys(fields: DataFrame, k: int = 12) -> DataFrame:
    counted = fields.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "key").limit(k)


# --- build files, facilities, numbers ---------------------------------------------------


def build_flag_counts(files: DataFrame) -> DataFrame:
    """``category, label, n, files`` over build files, ``files`` being how many were read; flags
    that never occur are left out."""
    return (
        files.select(F.inline(C.counts_of(F.col("text"), rules.BUILD_FLAGS)))
        .groupBy(F.col("label0").alias("category"), F.col("label1").alias("label"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))  # a file has a row for every flag
        .where(F.col("n") > 0)
    )


def missing_build_categories(flags: DataFrame) -> DataFrame:
    """Categories worth having of which no flag was found, with the suggestion."""
    wanted = small_table(flags.sparkSession, ["category", "suggestion"], rules.SUGGESTIONS.items())
    return wanted.join(flags, "category", "left_anti")


def bypass_uses(lines: DataFrame) -> DataFrame:
    """``facility, origin, n`` of the lines that use a facility."""
    line = F.col("stripped")
    ruled = C.counts_of(line, rules.WRAPPED)
    crc = F.transform(
        F.regexp_extract_all(line, F.lit(rules.CRC_CALL), F.lit(1)),
        lambda name: F.struct(F.lit("crc").alias("label0"), name.alias("label1"), F.lit(1).cast("bigint").alias("n")),
    )
    found = F.filter(F.concat(ruled, crc), lambda r: r["n"] > 0)
    return lines.select(F.inline(found)).select(F.col("label0").alias("facility"), F.col("label1").alias("origin"), "n")


def mixed_uses(uses: DataFrame) -> DataFrame:
    """:func:`bypass_uses` summed, and whether a facility is used in two ways or more."""
    used = uses.groupBy("facility", "origin").agg(F.sum("n").alias("n"))
    ways = used.groupBy("facility").agg((F.count(F.lit(1)) >= 2).alias("mixed"))
    return used.join(ways, "facility")


def wrapper_bypass(lines: DataFrame) -> DataFrame:
    """``facility, origin, n, mixed``: distinct ways one facility is used; ``mixed`` when
    there are two or more."""
    return mixed_uses(bypass_uses(lines))


def magic_number_lines(lines: DataFrame) -> DataFrame:
    """Lines with unnamed literals of two or more digits: ``path, line_no, snippet, n``."""
    line = F.col("stripped")
    trimmed = F.btrim(line, F.lit(" \t\r\n\f\u000b"))
    open_to_count = (trimmed != "") & ~trimmed.startswith("#") & ~trimmed.rlike(rules.CONSTANT_LINE)
    n = F.regexp_count(line, F.lit(rules.MAGIC_NUMBER)).cast("bigint")
    found = lines.where(open_to_count).select("path", "line_no", C.snippet(line).alias("snippet"), n.alias("n"))
    return found.where(F.col("n") > 0)


def magic_number_counts(lines: DataFrame) -> DataFrame:
    """Unnamed literals of two or more digits per file."""
    return magic_number_lines(lines).groupBy("path").agg(F.sum("n").alias("n"))


def magic_number_samples(found: DataFrame, files: int = 4, k: int = 3) -> DataFrame:
    """The first ``k`` of :func:`magic_number_lines` of the ``files`` files that have most."""
    most = found.groupBy("path").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "path").limit(files)
    order = Window.partitionBy("path").orderBy("line_no")
    ranked = found.join(F.broadcast(most.select("path")), "path").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("path", "line_no", "snippet")


def duplicate_blocks(files: DataFrame, window: int = 5) -> DataFrame:
    """Blocks of ``window`` normalised non-blank lines that occur more than once:
    ``block, copies, files, first_path, first_line``.

    ``files`` holds ``path, text``.  Blocks are cut inside a file's own row and
    only their digests are shuffled.
    """
    numbered = F.transform(
        C.split_lines(F.col("text")),
        lambda l, i: F.struct(
            (i + 1).cast("bigint").alias("line_no"),
            F.btrim(F.regexp_replace(l, r"\s+", " ")).alias("line"),
        ),
    )
    kept = once(files.select("path", "text"), kept=F.filter(numbered, lambda l: l["line"] != ""))
    none = F.lit(None).cast("string")
    following = [C.shifted(F.col("kept.line"), -k, none).alias(f"l{k}") for k in range(window)]
    rows = kept.select(
        "path", F.inline(F.arrays_zip(F.col("kept.line_no").alias("line_no"), *following))
    ).where(F.col(f"l{window - 1}").isNotNull())
    text = F.concat_ws("\n", *[F.col(f"l{k}") for k in range(window)])
    blocks = rows.select("path", "line_no", F.sha2(text, 256).alias("block"))
    per_file = blocks.groupBy("block", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")
    )
    return (
        per_file.groupBy("block")
        .agg(
            F.sum("n").alias("copies"),
            F.count(F.lit(1)).alias("files"),
            F.min(F.struct("path", "first_line")).alias("first"),
        )
        .where(F.col("copies") > 1)
        .select("block", "copies", "files", F.col("first.path").alias("first_path"), F.col("first.first_line").alias("first_line"))
    )


# --- files ----------------------------------------------------------------------------


def file_stats(corpus: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``path, loc, includes, todos`` per file, and ``functions`` when spans are given."""
    raw = C.split_lines(F.col("text"))
    stripped = C.split_lines(F.col("code"))
    stats = once(corpus.select("path", "text"), code=C.strip_comments(F.col("text"))).select(
        "path",
        F.size(raw).cast("bigint").alias("loc"),
        F.size(F.filter(stripped, lambda l: l.rlike(rules.INCLUDE))).cast("bigint").alias("includes"),
        F.size(F.filter(raw, lambda l: l.rlike(rules.TODO))).cast("bigint").alias("todos"),
    )
    if spans is None:
        return stats
    counted = spans.groupBy("path").agg(F.count(F.lit(1)).alias("functions"))
    return stats.join(counted, "path", "left").na.fill(0, ["functions"])


def corpus_totals(corpus: DataFrame) -> DataFrame:
    return corpus.agg(
        F.count(F.lit(1)).alias("scanned_files"),
        F.coalesce(F.sum(F.size(C.split_lines(F.col("text")))), F.lit(0)).alias("total_loc"),
    )


def churn_x_size(stats: DataFrame, changes: DataFrame, since: str, cap: int = 3000) -> DataFrame:
    """Files changed since a date: ``path, commits, loc, risk`` with risk = commits x
    min(loc, cap)."""
    counted = (
        changes.where(F.col("committed_at") >= F.lit(since).cast("timestamp_ntz"))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("commits"))
    )
    return counted.join(stats, "path").select(
        "path", "commits", "loc", (F.col("commits") * F.least("loc", F.lit(cap))).alias("risk")
    )


def top_files_by_size(stats: DataFrame, k: int = 15) -> DataFrame:
    return stats.select("path", "loc").orderBy(F.col("loc").desc(), "path").limit(k)


def longest_functions(spans: DataFrame, k: int = 15) -> DataFrame:
    order = [F.col(c).desc() for c in ("length", "path", "start", "name")]
    return spans.orderBy(*order).limit(k)


def include_heavy_headers(stats: DataFrame, k: int = 15) -> DataFrame:
    return (
        stats.where(is_header(F.col("path")))
        .select("path", "includes")
        .orderBy(F.col("includes").desc(), "path")
        .limit(k)
    )


def todo_hotspots(stats: DataFrame, k: int = 15) -> DataFrame:
    return stats.where("todos > 0").select("path", "todos").orderBy(F.col("todos").desc(), "path").limit(k)


def coverage_gap(corpus: DataFrame, read: DataFrame) -> DataFrame:
    """Files in scope that no batch has read."""
    return corpus.select("path").join(read.select("path"), "path", "left_anti")


# --- reports over scans ---------------------------------------------------------------


def section_counts(corpus: DataFrame) -> DataFrame:
    """``section, label, n`` of the rule sections of a scan; the corpus is read once."""
    scan = scan_lines(corpus)
    lines = scan.where("line_no IS NOT NULL")
    parts = [("red_flags", red_flag_scan(lines)), ("red_flags", reach_out_includes(lines)), ("header_hygiene", scan_hygiene(scan))]
    rows = None
    for section, hits in parts:
        named = hits.select(F.lit(section).alias("section"), F.col("rule").alias("label"))
        rows = named if rows is None else rows.unionByName(named)
    return rows.groupBy("section", "label").agg(F.count(F.lit(1)).alias("n"))


def scan_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each section count between two scans: new, gone, better, worse, same."""
    old, new = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    joined = before.withColumnRenamed("n", "before").join(
        after.withColumnRenamed("n", "after"), ["section", "label"], "full"
    )
    change = (
        F.when((old == 0) & (new > 0), "new")
        .when((old > 0) & (new == 0), "gone")
        .when(new < old, "better")
        .when(new > old, "worse")
        .otherwise("same")
    )
    return joined.select(
        "section", "label", old.alias("before"), new.alias("after"), (new - old).alias("delta"), change.alias("change")
    )


def iteration_trend(snapshots: DataFrame) -> DataFrame:
    """Growth of each metric against its first round and against the round before.

    ``snapshots`` holds one row per ``name, round`` with ``metric``.
    """
    first = snapshots.groupBy("name").agg(F.min_by("metric", "round").alias("baseline"))
    before = F.lag("metric").over(Window.partitionBy("name").orderBy("round"))
    return (
        snapshots.withColumn("previous", before)
        .join(first, "name")
        .select(
            "name",
            "round",
            "metric",
            (F.col("metric") - F.col("baseline")).alias("growth"),
            (F.col("metric") - F.col("previous")).alias("step"),
        )
    )


def _place(rows: DataFrame, order: list[str]) -> Column:
    """Text that sorts like the given columns (``-n``: largest number first)."""
    types = dict(rows.dtypes)
    parts = []
    for name in order:
        column = F.col(name.lstrip("-"))
        if name.startswith("-"):
            column = F.lit(Decimal(10**37)) - column.cast("decimal(38, 0)")
        if types[name.lstrip("-")] != "string":
            column = F.lpad(column.cast("string"), 38, "0")
        parts.append(column)
    return F.concat_ws("\u0001", *parts)


def scan_partials(corpus: DataFrame) -> Callable[[str], DataFrame]:
    """What all sections of a report are made of: the corpus is read once, its findings become one
    long table, written by section, and the returned function gives a section's rows.

    Rows are ``path, line_no, rule, snippet, n, includes, todos``; a section uses what it needs.
    """
    scan = scan_lines(corpus)
    lines = scan.where("line_no IS NOT NULL")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    stripped, raw = F.col("stripped"), F.col("raw")
    files = scan.groupBy("path").agg(
        F.count("line_no").alias("n"),
        F.count_if(stripped.rlike(rules.INCLUDE)).alias("includes"),
        F.count_if(raw.rlike(rules.TODO)).alias("todos"),
    )
    members = F.array(
        *[
            F.struct(
                F.lit(label).alias("rule"),
                F.regexp_extract("stripped", pattern, 0).alias("snippet"),
                F.regexp_count("stripped", F.lit(pattern)).cast("bigint").alias("n"),
            )
            for label, pattern in rules.MEMBER_RULES
        ]
    )
    parts = {
        "files": files,
        "spans": function_spans(lines).select("path", F.col("start").alias("line_no"), F.col("name").alias("rule"), F.col("length").alias("n")),
        "hits": red_flag_scan(lines).unionByName(reach_out_includes(lines)).unionByName(printf_spec_scan(lines)),
        "hygiene": scan_hygiene(scan),
        "members": lines.select("path", "line_no", F.inline(F.filter(members, lambda m: m["n"] > 0))),
        "fields": log_field_scan(lines).select("path", "line_no", F.col("key").alias("rule"), F.col("separator").alias("snippet")),
        "classes": header_class_rows(lines).select("path", "line_no", F.col("name").alias("rule")),
        "bypass": bypass_uses(lines).select(F.col("facility").alias("rule"), F.col("origin").alias("snippet"), "n"),
        "magic": magic_number_lines(lines),
    }
    long = None
    kinds = {"path": text, "line_no": number, "rule": text, "snippet": text, "n": number, "includes": number, "todos": number}
    for section, rows in parts.items():
        full = rows.select(F.lit(section).alias("section"), *[F.col(c) if c in rows.columns else v.alias(c) for c, v in kinds.items()])
        long = full if long is None else long.unionByName(full)
    path = fresh_dir(corpus.sparkSession, "scan-partials")
    long.write.partitionBy("section").parquet(path)
    written = corpus.sparkSession.read.schema(long.schema).parquet(path)
    return lambda section: written.where(F.col("section") == section).drop("section")


def scan_report_json(corpus: DataFrame, builds: DataFrame, changes: DataFrame, since: str, k: int = 15) -> DataFrame:
    """The whole scan as ``section, place, text`` lines; their texts joined by newlines
    are one JSON document.

    Lines rather than one string: the document is never held in one row, and
    ``sinks.write_report`` writes it in order.  The scan itself runs while the plan is built.
    """
    part = scan_partials(corpus)
    stats = part("files").select("path", F.col("n").alias("loc"), "includes", "todos")
    spans = part("spans").select("path", F.col("line_no").alias("start"), F.col("rule").alias("name"), F.col("n").alias("length"))
    fields = part("fields").select(F.col("rule").alias("key"), F.col("snippet").alias("separator"), C.name_style(F.col("rule")).alias("style"))
    hits, hygiene = (part(name).select("path", "line_no", "rule", "snippet") for name in ("hits", "hygiene"))
    magic = part("magic").select("path", "line_no", "snippet", "n")
    members = part("members")
    counted = members.groupBy("rule").agg(F.sum("n").alias("n"))
    member_rules = small_table(corpus.sparkSession, ["rule"], [(label,) for label, _ in rules.MEMBER_RULES])
    first = Window.partitionBy("rule").orderBy("path", "line_no")
    member_samples = members.withColumn("rank", F.row_number().over(first)).where("rank <= 3")
    uses = part("bypass").select(F.col("rule").alias("facility"), F.col("snippet").alias("origin"), "n")
    flags = stored(build_flag_counts(builds), "scan-builds")
    churn = churn_x_size(stats, changes, since).orderBy(F.col("risk").desc(), F.col("path").desc()).limit(k)
    per_file = magic.groupBy("path").agg(F.sum("n").alias("n"))
    classes = multi_class_headers(part("classes").select("path", "line_no", F.col("rule").alias("name")))
    totals = stats.agg(F.count(F.lit(1)).alias("scanned_files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"))
    sections: list[tuple[str, DataFrame, list[str]]] = [
        ("totals", totals, ["scanned_files"]),
        ("top_files_by_size", top_files_by_size(stats, k), ["-loc", "path"]),
        ("longest_functions", longest_functions(spans, k), ["-length", "path", "start"]),
        ("include_heavy_headers", include_heavy_headers(stats, k), ["-includes", "path"]),
        ("todo_hotspots", todo_hotspots(stats, k), ["-todos", "path"]),
        ("churn_x_size", churn, ["-risk", "path"]),
        ("red_flags", hit_totals(hits), ["-hits", "rule"]),
        ("header_hygiene", hit_totals(hygiene), ["-hits", "rule"]),
        ("function_naming", naming_distribution(spans), ["-functions", "style"]),
        ("function_naming_samples", function_naming_samples(spans), ["path", "start"]),
        ("member_naming", member_rules.join(counted, "rule", "left").na.fill(0, ["n"]), ["rule"]),
        ("member_naming_samples", member_samples.select("rule", "path", "line_no", F.col("snippet").alias("name")), ["rule", "path", "line_no"]),
        ("log_field_style", log_field_style(fields), ["kind", "label"]),
        ("top_log_keys", top_log_keys(fields), ["-n", "key"]),
        ("build_hardening", flags, ["category", "label"]),
        ("build_files", builds.agg(F.count(F.lit(1)).alias("files_scanned")), ["files_scanned"]),
        ("missing_categories", missing_build_categories(flags), ["category"]),
        ("runtime_cost", small_table(flags.sparkSession, ["category", "cost"], rules.RUNTIME_COST.items()), ["category"]),
        ("header_composition", classes.orderBy(F.col("classes").desc(), "path").limit(10), ["-classes", "path"]),
        ("wrapper_bypass", mixed_uses(uses), ["facility", "-n", "origin"]),
        ("magic_numbers", per_file.orderBy(F.col("n").desc(), "path").limit(10), ["-n", "path"]),
        ("magic_number_samples", magic_number_samples(magic), ["path", "line_no"]),
        ("magic_number_total", magic.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")), ["total"]),
    ]
    frame, entries = [(-1, "", "{")], None
    for number, (name, rows, order) in enumerate(sections):
        frame.append((3 * number, "", f'  "{name}": ['))
        frame.append((3 * number + 2, "", "  ]" if number == len(sections) - 1 else "  ],"))
        listed = rows.select(
            F.lit(3 * number + 1).alias("section"), _place(rows, order).alias("place"), F.to_json(F.struct("*")).alias("entry")
        )
        entries = listed if entries is None else entries.unionByName(listed)
    frame.append((3 * len(sections), "", "}"))
    entries = stored(entries, "scan-report")
    last = entries.groupBy("section").agg(F.max("place").alias("last"))
    comma = F.when(F.col("place") == F.col("last"), "").otherwise(",")
    body = entries.join(last, "section").select(
        "section", "place", F.concat(F.lit("    "), F.col("entry"), comma).alias("text")
    )
    fixed = small_table(corpus.sparkSession, ["section", "place", "text"], frame)
    return fixed.unionByName(body).orderBy("section", "place")
