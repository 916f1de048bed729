"""Readers that deliver each operator family's input table."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions.text import glob_match
from opslens.sources import files

# What counts as source code, as a header, and which folders hold
# foreign or generated code.
CODE_EXTENSIONS = ["cpp", "cc", "cxx", "c", "h", "hpp", "hh", "hxx", "inl", "ipp", "tcc"]
HEADER_EXTENSIONS = ["h", "hpp", "hh", "hxx", "inl"]
SKIPPED_FOLDERS = [
    ".git", ".hg", ".svn", ".vs", ".vscode", ".idea", ".cache", ".github",
    "build", "builds", "out", "output", "bin", "obj", "libs",
    "cmake-build-debug", "cmake-build-release", "_deps", "buildroot",
    "third_party", "thirdparty", "3rdparty", "external", "vendor", "deps",
    "node_modules", "generated", "gen", "autogen",
]
BUILD_SUFFIXES = [".cmake", ".vcxproj", ".mk"]
BUILD_NAMES = ["cmakelists.txt", "makefile", "meson.build", "build.bazel", "workspace"]


# --- log files ------------------------------------------------------------------


def file_lines(raw: DataFrame, source_type: str) -> DataFrame:
    """Columns every text scan delivers: ``source, block, text, bytes, source_type``."""
    return raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", r"\r\z", "").alias("text"),
        # the newline is counted for every line, also where the last one lacks it
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"),
        F.lit(source_type).alias("source_type"),
    )


def number_file_lines(lines: DataFrame) -> DataFrame:
    """Turn ``block`` into ``line_no``, the 1-based number of a line in its file.

    Files may be split: lines are numbered inside each split, then shifted by the
    sizes of the earlier splits of the file.
    """
    placed = lines.withColumn("__at", F.monotonically_increasing_id())
    inside = Window.partitionBy("source", "block").orderBy("__at")
    sizes = lines.groupBy("source", "block").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("source", "block", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__shift"))
    return (
        placed.withColumn("__n", F.row_number().over(inside))
        .join(shift, ["source", "block"])
        .withColumn("line_no", (F.col("__n") + F.col("__shift")).cast("bigint"))
        .drop("block", "__at", "__n", "__shift")
    )


def read_log_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    source_type: str = "file",
    include: str | None = None,
    excludes: Sequence[str] = (),
) -> DataFrame:
    """Lines of log files with source, 1-based line number and ingest time.

    Only ``\\n`` ends a line; one trailing ``\\r`` is removed.
    """
    reader = spark.read.option("lineSep", "\n")
    if include:
        reader = reader.option("pathGlobFilter", include)
    lines = file_lines(reader.text(paths), source_type)
    if excludes:
        lines = lines.where(glob_match(F.col("source"), "*", list(excludes)))
    return number_file_lines(lines).select(
        "source", "line_no", F.current_timestamp().alias("ingested_ts"), "text", "bytes", "source_type"
    )


def union_sources(**kinds: DataFrame) -> DataFrame:
    """Inputs of several kinds as one table, ``source_type`` naming the kind."""
    shared = ["source", "line_no", "text"]
    parts = [df.select(*shared, F.lit(kind).alias("source_type")) for kind, df in kinds.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Configured paths with ``.``, ``..`` and doubled slashes resolved, once each."""
    rooted = F.col("path").startswith("/")
    parts = F.filter(F.split("path", "/"), lambda p: ~p.isin("", "."))

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.size(acc)), F.lit("..")) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(part))
        )

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    normal = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))
    return paths.select(normal.alias("path")).distinct()


# --- task results -----------------------------------------------------------------


def read_task_results(spark: SparkSession, folder: str, prefix: str, day: str) -> tuple[DataFrame, bool]:
    """Lines of ``<prefix>_<YYYYMMDD>.log`` and whether the file exists."""
    path = f"{folder.rstrip('/')}/{prefix}_{day.replace('-', '')}.log"
    try:
        lines = spark.read.option("lineSep", "\n").text(path)
        found = True
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
        found = False
    return lines.select(F.regexp_replace("value", r"\r\z", "").alias("text")), found


def read_result_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Lines of the days ``first`` to ``last`` (``yyyyMMdd``) of a folder written by
    ``write_task_results``; other days are not opened."""
    rows = spark.read.schema("value string, day string").option("lineSep", "\n").text(path)
    wanted = F.col("day").between(first, last)
    return rows.where(wanted).select("day", F.regexp_replace("value", r"\r\z", "").alias("text"))


# --- source files -------------------------------------------------------------------


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1))


def in_skipped_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(f) for f in SKIPPED_FOLDERS]))


def is_build_file(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    wanted = name.isin(*BUILD_NAMES)
    for suffix in BUILD_SUFFIXES:
        wanted = wanted | name.endswith(suffix)
    return wanted


def _any_case(name: str) -> str:
    """Glob that matches a name in any case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def _uri(root: str) -> str:
    """The root as a URI; plain paths are local ones."""
    return root if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", root) else f"file://{os.path.abspath(root)}"


def _text_files(
    spark: SparkSession, root: str, globs: Sequence[str], names: str, wanted: Column, include_all: bool, **options
) -> DataFrame:
    """Text files below ``root``, chosen by name while they are listed.

    Tasks open the files themselves and read a binary file's head only.  A store that only Spark's
    own readers reach is read by these, whole files at a time and without empty ones.
    """
    if files.can_open(_uri(root)):
        spark.dataSource.register(files.SourceTree)
        reader = spark.read.format("source_tree").option("root", _uri(root)).option("names", names)
        return reader.option("skipped", "" if include_all else "\n".join(SKIPPED_FOLDERS)).options(**options).load()
    top = re.sub(r"\A[a-z0-9]+:/+", "/", root.rstrip("/"))
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + ",".join(globs) + "}")
        .load(root)
        .withColumn("path", F.regexp_replace("path", r"\A[a-z0-9]+:/+", "/"))
    )
    below = F.substring("path", F.lit(len(top) + 2), F.length("path"))
    listed = listed.withColumn("path", below).where(wanted)
    if not include_all:
        listed = listed.where(~in_skipped_folder(F.col("path")))
    # One character per byte, so that a NUL byte can be looked for.
    head = F.decode(F.substring("content", 1, files.HEAD_BYTES), "ISO-8859-1")
    return listed.where(~F.contains(head, F.lit("\u0000"))).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_corpus(spark: SparkSession, root: str, include_all: bool = False, **options) -> DataFrame:
    """``path, text`` of source files below ``root``; binaries and foreign folders
    are left out, undecodable bytes are replaced.  ``options`` go to the data source."""
    globs = [f"*.{_any_case(e)}" for e in CODE_EXTENSIONS]
    names = rf"[^/]\.({'|'.join(CODE_EXTENSIONS)})\Z"
    return _text_files(spark, root, globs, names, extension(F.col("path")).isin(*CODE_EXTENSIONS), include_all, **options)


def read_build_files(spark: SparkSession, root: str, include_all: bool = False, **options) -> DataFrame:
    """``path, text`` of build files below ``root``, as :func:`read_corpus` reads sources."""
    globs = [_any_case(n) for n in BUILD_NAMES] + [f"*{_any_case(s)}" for s in BUILD_SUFFIXES]
    exact, ends = "|".join(map(re.escape, BUILD_NAMES)), "|".join(map(re.escape, BUILD_SUFFIXES))
    return _text_files(spark, root, globs, rf"\A({exact})\Z|({ends})\Z", is_build_file(F.col("path")), include_all, **options)


# --- findings and feedback ------------------------------------------------------------

FINDING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "severity", "category", "file")]
    + [T.StructField("line", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("title", "detail", "fix")]
)
FINDINGS_SCHEMA = T.StructType(
    [
        T.StructField(
            "review",
            T.StructType([T.StructField(n, T.StringType()) for n in ("repo", "scope", "coverage", "date")]),
        ),
        T.StructField("summary", T.StringType()),
        T.StructField(
            "systemic",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("title", T.StringType()),
                        T.StructField("count", T.LongType()),
                        T.StructField("examples", T.ArrayType(T.StringType())),
                        T.StructField("recommendation", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("findings", T.ArrayType(FINDING)),
    ]
)
FEEDBACK_SCHEMA = (
    "report string, findings_file string, repo string, scope string, exported_at string, total_findings bigint, "
    "decided bigint, verdicts map<string, struct<verdict string, comment string, severity string, file string, "
    "line bigint, title string, fix string>>"
)


def read_review_documents(spark: SparkSession, paths: str | Sequence[str], per_line: bool = False) -> DataFrame:
    """One row per findings document with its path; a byte-order mark is tolerated.

    A document is a whole file, or a line of a file with ``per_line``.
    """
    return (
        spark.read.schema(FINDINGS_SCHEMA)
        .option("multiLine", str(not per_line).lower())
        .json(paths)
        .withColumn("document", F.col("_metadata.file_path"))
    )


def read_findings(documents: DataFrame) -> DataFrame:
    """One row per finding; a missing id becomes ``F<n>`` by position."""
    rows = documents.select("document", F.posexplode("findings").alias("pos", "f"))
    return rows.select(
        "document", "pos", F.coalesce("f.id", F.concat(F.lit("F"), F.col("pos") + 1)).alias("id"),
        *[F.col(f"f.{f.name}").alias(f.name) for f in FINDING if f.name != "id"],
    )


def read_systemic(documents: DataFrame) -> DataFrame:
    rows = documents.select("document", F.posexplode("systemic").alias("pos", "s"))
    return rows.select(
        "document", "pos", F.coalesce("s.id", F.concat(F.lit("S"), F.col("pos") + 1)).alias("id"),
        "s.title", "s.count", "s.examples", "s.recommendation",
    )


#: Lines that Spark's JSON parsers over bytes and over characters may read differently: other encodings,
#: escaped surrogates or letters, and other values than text where a verdict holds text.
_ODD_LINE = (
    r"""\x00|\x{FEFF}|\\u(?:[dD][89A-Fa-f]|00[4-7])"""
    r"""|["'](?:verdict|comment|severity|file|title|fix)["']\s*:\s*(?!null\b)[^"'\s]"""
)


def read_feedback(spark: SparkSession, paths: str | Sequence[str], per_line: bool = False) -> DataFrame:
    """One row per verdict: ``id, verdict, comment, severity, file, line, title, fix``.

    Verdicts are keyed by ids that hardly repeat.  The parser over bytes copies its table of known keys,
    up to 6000, for every line that brings a new one; the parser over characters copies far less, so
    lines go through it.  Only files with a line that both may read differently are left to the first;
    they are found by a pass over the lines while the plan is built.
    """

    def documents(**options: str) -> DataFrame:
        return spark.read.schema(FEEDBACK_SCHEMA).options(multiLine=str(not per_line).lower(), **options).json(paths)

    def verdicts(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode("verdicts").alias("id", "v")).select("id", "v.*")

    if not per_line:
        return verdicts(documents())
    place = F.col("_metadata.file_path")
    line = F.col("value")
    lines = spark.read.text(paths).where(~F.is_valid_utf8(line) | line.rlike(_ODD_LINE))
    odd = [row[0] for row in lines.select(place).distinct().collect()]
    fast = verdicts(documents(encoding="UTF-8").where(~place.isin(odd)) if odd else documents(encoding="UTF-8"))
    return fast.unionByName(verdicts(documents().where(place.isin(odd)))) if odd else fast
