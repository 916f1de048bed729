"""Tables in the shape of each operator family, derived from the driver tables.

Every view is a projection (or a bounded grouping) of one table: positions and
keys come from arithmetic on unique ids, so no view needs a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# The lines source files are made of, by template number.
TEMPLATES = [
    "#include <vector>",
    "#include <algorithm>",
    '#include "../x.h"',
    "#pragma once",
    "int run(int a) {",
    "}",
    "}",
    "// TODO fix",
    "/* new Foo */",
    'const char* s = "new Foo {";',
    "Foo* p = new Foo();",
    "free(p);",
    'printf("status=OK n=%d", v.size());',
    'log("url: http://x");',
    "if (p == NULL) goto done;",
    "x_ = m_value + _y;",
    "sleep_for(250);",
    "constexpr int kMax = 4096;",
    "std::time(nullptr);",
    "std::mt19937 r;",
    "class Widget",
    "{",
    "struct Pod {",
    "typedef struct T T;",
    "",
    "void Widget::load_all(int n) {",
    "}",
    "/* open",
    "close */ int z = 1234;",
    "}",
    "  virtual void f();",
    "uint32_t c = myCrc32(buf);",
    '#include "b.h"',
    '#include "f1.h"',
    "uint64_t now = std::chrono::steady_clock::now();  // HACK",
    "char q = '\"'; int k = 77;",
    "catch (...) { }",
    "int maxValue() {",
    "#ifndef GUARD_H",
    "  using namespace std;",
    "return a + 1;",
    "int result = compute(a);",
    "if (a > 10) {",
    "}",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a scan that comes in fewer pieces than there are cores.

    Meant for costly expressions over a small file.  A large scan already has more
    pieces than cores and is returned as it is, so no shuffle is added there.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _text(value: Column) -> Column:
    return value.cast("string")


def log_line_columns() -> list[Column]:
    """Log line columns over ``events``; one source holds a third of all lines."""
    event, user = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    other = F.expr("event_id div 3 * 2 + event_id % 3 - 1")
    hot = event % 3 == 0
    number = F.when(hot, F.lit(0)).otherwise(other % 4 + 1)
    line_no = F.when(hot, F.expr("event_id div 3")).otherwise(F.floor(other / 4)) + 1
    word = (
        F.when(kind == "error", "ERROR")
        .when(kind == "view", "DEBUG")
        .when(kind == "click", "notice")
        .when(kind == "purchase", "Warning")
        .otherwise("AUDIT")
    )
    note = F.when(event % 7 == 0, F.concat(F.lit(' note="took '), _text(event % 100), F.lit(' ms"'))).otherwise("")
    text = (
        F.when(event % 17 == 0, F.concat(F.lit("plain unparsed noise "), _text(event)))
        .when(event % 23 == 0, F.concat(F.lit("job=sync status=done id="), _text(event)))
        .otherwise(
            F.concat(
                F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                F.lit(" ["),
                word,
                F.lit("] evt user=u"),
                _text(user),
                F.lit(" type="),
                kind,
                note,
            )
        )
    )
    return [
        event.alias("line_id"),
        F.concat(F.lit("logs/app_"), _text(number), F.lit(".log")).alias("source"),
        F.when(number == 4, "glob").otherwise("file").alias("source_type"),
        line_no.cast("bigint").alias("line_no"),
        (event * 137).alias("ts_ms"),
        F.col("ts").alias("ingested_ts"),
        text.alias("text"),
    ]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return spread(events).select(*log_line_columns())


def task_result_columns() -> list[Column]:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = (
        F.when(key % 11 == 0, "CANCELLED")
        .when(key % 31 == 0, "BOGUS")
        .when(F.col("o_orderstatus") == "O", "OK")
        .when(F.col("o_orderstatus") == "F", "FAILED")
        .otherwise("RETRYING")
    )
    tag = F.when(key % 13 == 0, "-").otherwise(F.replace("o_orderpriority", F.lit(" "), F.lit("_")))
    worker = F.when(key % 11 == 0, "-").otherwise(_text(cust % 8))
    duration = (
        F.when(key % 11 == 0, " duration_us=-")
        .when(key % 5 == 0, F.concat(F.lit(" duration_ms="), _text(cust % 900), F.lit(".5")))
        .otherwise(F.concat(F.lit(" duration_us="), _text(cust * 37 % 1000003)))
    )
    text = F.when(key % 29 == 0, F.concat(F.lit("garbage "), _text(key))).otherwise(
        F.concat(
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
            F.lit(" task_id="),
            _text(key),
            F.lit(" status="),
            status,
            F.lit(" tag="),
            tag,
            F.lit(" type=oneshot worker="),
            worker,
            duration,
            F.lit(" detail=attempt "),
            _text(key % 3 + 1),
            F.lit(" of 3: tag=not_this_one"),
        )
    )
    return [key.alias("line_id"), text.alias("text")]


def task_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    return spread(orders).select(*task_result_columns())


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace lines of every task: a first attempt and, for some, a retry."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    events = ["enqueue", "dequeue", "start", "finish", "retry_requeue", "dequeue", "start", "finish"]
    steps = F.array(
        *[F.struct(F.lit(i + 1).cast("bigint").alias("seq"), F.lit(e).alias("event")) for i, e in enumerate(events)]
    )
    wanted = F.when(key % 19 == 0, 1).when(key % 5 == 0, 8).otherwise(4)
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(
        "o_orderkey", "o_custkey", F.inline(F.slice(steps, F.lit(1), wanted))
    )
    at = F.lit(1_700_000_000_000) + key * 10 + F.col("seq") * (cust % 97)
    stamp = F.date_format(F.timestamp_millis(at), "yyyy-MM-dd HH:mm:ss.SSS")
    extra = F.when(
        F.col("event") == "finish",
        F.concat(F.lit(" status="), F.when((key % 5 == 0) & (F.col("seq") == 4), "RETRYING").otherwise("OK")),
    ).otherwise("")
    return rows.select(
        key.alias("task_id"),
        "seq",
        F.concat(stamp, F.lit(" [trace] "), F.col("event"), F.lit(" task="), _text(key), extra).alias("text"),
    )


def _path_of(file_id: Column) -> Column:
    stem = F.floor(file_id / 3).cast("bigint")
    kind = file_id % 3
    return F.concat(
        F.lit("src/mod"),
        _text(stem % 9),
        F.when(kind == 2, F.lit("/g")).otherwise(F.lit("/f")),
        _text(stem),
        F.when(kind == 0, F.lit(".h")).otherwise(F.lit(".cpp")),
    )


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines ``path, line_no, raw`` from ``orders``; files of 30 to 160 lines."""
    key = F.col("o_orderkey")
    inside = key % 400
    starts = [(0, 30), (30, 90), (90, 200), (200, 360), (360, 400)]
    part = F.lit(0)
    first = F.lit(0)
    for i, (low, _high) in enumerate(starts):
        part = F.when(inside >= low, F.lit(i)).otherwise(part)
        first = F.when(inside >= low, F.lit(low)).otherwise(first)
    file_id = F.expr("o_orderkey div 400") * 5 + part
    tpl = F.col("o_custkey") % len(TEMPLATES)
    tpl = F.when((tpl == 27) & (key % 4 != 0), F.lit(24)).otherwise(tpl)
    lines = F.array(*[F.lit(t) for t in TEMPLATES])
    return table(spark, sf_dir, "orders").select(
        _path_of(file_id).alias("path"),
        (inside - first + 1).cast("bigint").alias("line_no"),
        F.element_at(lines, (tpl + 1).cast("int")).alias("raw"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text``: one row per file, as a file reader delivers it."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    return (
        code_rows(spark, sf_dir)
        .groupBy("path")
        .agg(rows.alias("rows"))
        .select("path", F.concat(F.array_join(F.col("rows.raw"), "\n"), F.lit("\n")).alias("text"))
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        _path_of(F.col("event_id") % 200).alias("path"),
        F.col("event_id").alias("commit_id"),
        F.col("ts").alias("committed_at"),
    )


def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text`` of build files, one per part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(key % 3 == 0, "CMakeLists.txt").when(key % 3 == 1, "flags.mk").otherwise("README.md")
    text = F.concat(
        F.lit("set(CMAKE_CXX_FLAGS -Wall -Wextra)\n"),
        F.when(size % 4 == 0, "add_compile_options(-Werror -Wshadow)\n").otherwise(""),
        F.when(size % 5 == 0, "FLAGS=-Werror=return-type /w4 /WX\n").otherwise(""),
        F.when(size % 7 == 0, "FLAGS=-fstack-protector-strong -D_FORTIFY_SOURCE=2\n").otherwise(""),
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("pkg"), _text(key), F.when(key % 11 == 0, "/build/").otherwise("/"), name).alias("path"),
        text.alias("text"),
    )


def finding_id() -> Column:
    return F.concat_ws(
        "-",
        F.lit("L"),
        _text(F.col("l_orderkey")),
        _text(F.col("l_linenumber")),
        _text(F.col("l_partkey")),
        _text(F.col("l_suppkey")),
        _text(F.round(F.col("l_extendedprice") * 100).cast("bigint")),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    severity = F.element_at(
        F.array(*[F.lit(s) for s in ["blocker", "MAJOR", " minor ", "Nit", "weird", "Minor"]]), (part % 6 + 1).cast("int")
    )
    category = F.element_at(
        F.array(*[F.lit(s) for s in ["concurrency", "api", "headers", "testing"]]), (supp % 4 + 1).cast("int")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 100").alias("review_id"),
        finding_id().alias("id"),
        severity.alias("severity"),
        category.alias("category"),
        F.concat(F.lit("src/mod"), _text(supp % 9), F.lit("/a"), _text(part % 200), F.lit(".cpp")).alias("file"),
        F.when(part % 10 == 0, F.lit(None).cast("bigint")).otherwise(part % 50).alias("line"),
        F.when(part % 41 == 0, "").otherwise(F.concat(F.lit("t"), _text(part % 30))).alias("title"),
        F.lit("d").alias("detail"),
        F.when(part % 43 == 0, " ").otherwise("fix it").alias("fix"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    flag = F.col("l_returnflag")
    open_yet = part % 4 == 0
    verdict = (
        F.when(open_yet, "")
        .when(flag == "A", "accept")
        .when(flag == "R", "reject")
        .otherwise(F.when(part % 2 == 0, "custom").otherwise(""))
    )
    return table(spark, sf_dir, "lineitem").select(
        finding_id().alias("id"),
        verdict.alias("verdict"),
        F.when(~open_yet & (F.col("l_suppkey") % 3 == 0), "note").otherwise("").alias("comment"),
    )


#: Rows that one task sorts into cells.
CELL_ROWS = 1 << 20


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sheet, col, row_no, content`` from ``lineitem``; a large table is dealt to as many tasks as
    its rows need, so that no task sorts more of a larger one."""
    part = F.col("l_partkey")
    content = (
        F.when(part % 9 == 0, "text")
        .when(part % 9 == 1, " true ")
        .when(part % 97 == 2, "#DIV/0!")
        .otherwise(_text(part % 1000))
    )
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(
        F.expr("l_orderkey div 10").alias("sheet"),
        F.col("l_linenumber").cast("bigint").alias("col"),
        (F.col("l_orderkey") % 10 + 1).alias("row_no"),
        content.alias("content"),
    )
    wanted = -(-items.count() // CELL_ROWS)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(wanted, "sheet", "col", "row_no")
    return rows.groupBy("sheet", "col", "row_no").agg(F.max("content").alias("content"))


# Corner columns and rows of the ranges every sheet is asked for; ends may be
# reversed, one range is a single cell and one lies outside all cells.
RANGES = [
    ("r1", 1, 1, 3, 4),
    ("r2", 5, 9, 2, 2),
    ("r3", 4, 4, 4, 4),
    ("r4", 8, 1, 9, 5),
    ("r5", 1, 1, 7, 10),
]


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sheet, range_id, c1, r1, c2, r2`` for every sheet of ``orders``."""
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("range_id"),
                *[F.lit(v).cast("bigint").alias(n) for n, v in zip(("c1", "r1", "c2", "r2"), corners)],
            )
            for i, *corners in RANGES
        ]
    )
    sheets = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 10").alias("sheet")).distinct()
    return sheets.select("sheet", F.inline(wanted))


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sheet, col, row_no, formula``: a cell refers to two cells of the next row;
    every seventh sheet closes a loop from its last row to its first."""
    letter = lambda c: F.char(c + 64)
    col, row = F.col("col"), F.col("row_no")
    next_row = _text(row + 1)
    down = F.concat(
        F.lit("="), letter(col), next_row, F.lit("+$"), letter(col % 7 + 1), F.lit("$"), next_row
    )
    loop = F.concat(F.lit("="), letter(col), F.lit("1"))
    return cells(spark, sf_dir).select(
        "sheet",
        "col",
        "row_no",
        F.when(row < 10, down)
        .when(F.col("sheet") % 7 == 0, loop)
        .otherwise(F.col("content"))
        .alias("formula"),
    )


def b64_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    plain = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")
    safe = F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))
    wrapped = F.regexp_replace(plain, "(.{76})(?=.)", "$1\r\n")
    head, tail = F.substring(plain, 1, 4), F.substring(plain, F.lit(5), F.length(plain))
    value = (
        F.when(doc % 6 == 0, plain)
        .when(doc % 6 == 1, safe)
        .when(doc % 6 == 2, wrapped)
        .when(doc % 6 == 3, F.concat(head, F.lit("!"), tail))
        .when(doc % 6 == 4, F.substring(plain, F.lit(1), F.length(plain) - 1))
        .otherwise(F.concat(head, F.lit(" "), tail))
    )
    mode = (
        F.when(doc % 6 == 1, "url")
        .when((doc % 6 == 2) & (doc % 4 != 0), "mime")
        .when((doc % 6 == 5) & (doc % 2 == 1) & (doc % 5 != 0), "lenient")
        .otherwise("strict")
    )
    return documents(spark, sf_dir).select(
        "doc_id", F.col("source").alias("origin"), value.alias("value"), mode.alias("mode")
    )


def level_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, name, value``: requests to register level words."""
    user = F.col("user_id")
    name = (
        F.when(user % 20 == 3, "")
        .when(user % 20 == 5, "warn")
        .otherwise(F.concat(F.upper("event_type"), _text(user % 6)))
    )
    value = F.when(user % 20 == 7, F.lit(1000)).when(user % 50 == 11, user % 900).otherwise(user % 6 + 10)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), name.alias("name"), value.cast("bigint").alias("value")
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``app, layer, profile, seq, key, value``: layered settings entries."""
    event, user = F.col("event_id"), F.col("user_id")
    names = [
        "input.file", "input.files", "rotate_daily", "rotate.daily", "extract_kv", "extract.kv",
        "output_format", "output.format", "max_lines_per_sec", "rate.max_lines_per_sec", "stop_file", "level",
    ]
    key = F.element_at(F.array(*[F.lit(n) for n in names]), (event % 12 + 1).cast("int"))
    layer = F.element_at(F.array(F.lit("file"), F.lit("profile"), F.lit("env")), (event % 5 % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("app"), _text(user % 50)).alias("app"),
        layer.alias("layer"),
        F.when(layer == "profile", F.when(event % 2 == 0, "prod").otherwise("test")).alias("profile"),
        event.alias("seq"),
        key.alias("key"),
        F.concat(F.col("event_type"), F.lit("-"), _text(event)).alias("value"),
    )


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name``: file names of a statistics export folder."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(
            F.when(event % 3 == 0, F.lit("main")).otherwise(F.concat(F.lit("job"), _text(event % 7))),
            F.lit("_"),
            F.date_format("ts", "yyyyMMdd_HHmmss"),
            F.lit("_"),
            _text(event),
            F.when(event % 29 == 0, ".tmp").otherwise(".prom"),
        ).alias("name")
    )
