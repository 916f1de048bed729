"""Registered queries of the source corpus family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens import rules
from opslens.functions import code as C
from opslens.operators import corpus as ops
from opslens.operators.staging import small_table, stored
from opslens.plans.oracle import VIEWS, sql
from opslens.session import fresh_dir
from opslens.sources import readers, sinks, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = sql(oracle)
        return build

    return register


def lines(spark, sf):
    return ops.explode_code_lines(views.corpus(spark, sf))


def spans(spark, sf):
    return ops.function_spans(lines(spark, sf))


SINCE = "2024-01-10"
READ_SINCE = "2024-01-27"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# What stripping leaves of the templates that hold comments or literals.
_STRIPPED = {
    2: "'#include \"' || repeat(' ', 6) || '\"'",
    7: "repeat(' ', 11)",
    8: "repeat(' ', 13)",
    9: "'const char* s = \"' || repeat(' ', 9) || '\";'",
    12: "'printf(\"' || repeat(' ', 14) || '\", v.size());'",
    13: "'log(\"' || repeat(' ', 13) || '\");'",
    27: "repeat(' ', 7)",
    32: "'#include \"' || repeat(' ', 3) || '\"'",
    33: "'#include \"' || repeat(' ', 4) || '\"'",
    34: "'uint64_t now = std::chrono::steady_clock::now();  ' || repeat(' ', 7)",
    35: "'char q = '' ''; int k = 77;'",
}
VIEWS["templates"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_quote(raw)}, {_STRIPPED.get(i, _quote(raw))})" for i, raw in enumerate(views.TEMPLATES)
) + ") t(tpl, raw, code)"

_FILE = """'src/mod' || CAST((fid // 3) % 9 AS VARCHAR) || CASE WHEN fid % 3 = 2 THEN '/g' ELSE '/f' END
  || CAST(fid // 3 AS VARCHAR) || CASE WHEN fid % 3 = 0 THEN '.h' ELSE '.cpp' END"""
VIEWS["code_lines"] = f"""
SELECT path, line_no, fid, tpl, raw, fid % 3 = 0 AS is_header, count(*) OVER (PARTITION BY path) AS loc,
  CASE WHEN NOT inside THEN code WHEN tpl = 28 THEN repeat(' ', 8) || ' int z = 1234;' ELSE repeat(' ', strlen(raw)) END AS stripped
FROM (SELECT x.*, t.raw, t.code, {_FILE} AS path,
    coalesce(last_value(CASE WHEN x.tpl = 27 THEN 1 WHEN x.tpl IN (8, 28) THEN 0 END IGNORE NULLS)
      OVER (PARTITION BY fid ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside
  FROM (SELECT (o_orderkey // 400) * 5 + part AS fid, k - starts[part + 1] + 1 AS line_no,
      CASE WHEN o_custkey % {len(views.TEMPLATES)} = 27 AND o_orderkey % 4 <> 0 THEN 24 ELSE o_custkey % {len(views.TEMPLATES)} END AS tpl
    FROM (SELECT *, o_orderkey % 400 AS k, [0, 30, 90, 200, 360] AS starts,
        CASE WHEN o_orderkey % 400 >= 360 THEN 4 WHEN o_orderkey % 400 >= 200 THEN 3 WHEN o_orderkey % 400 >= 90 THEN 2
             WHEN o_orderkey % 400 >= 30 THEN 1 ELSE 0 END AS part FROM orders) o) x
  JOIN templates t ON t.tpl = x.tpl) y"""

# Rules RE2 cannot state are spelled out; all others are the same pattern.
_SPECIAL = {
    "catch by value": "regexp_matches(stripped, 'catch\\s*\\(\\s*(const\\s+)?([A-Z][\\w:]*|[\\w:]+::[\\w:]+)(\\s*<[^<>]*>)?(\\s+const)?\\s+[A-Za-z_]\\w*\\s*\\)')",
    "virtual without override": "regexp_matches(stripped, '\\bvirtual\\b') AND NOT regexp_matches(stripped, '\\bvirtual\\b[^;]*(\\boverride\\b|=\\s*0|\\bfinal\\b|~)')",
}
_RULE_TESTS = " UNION ALL ".join(
    f"SELECT path, line_no, raw, {_quote(label)} AS rule FROM code_lines WHERE "
    + _SPECIAL.get(label, f"regexp_matches(stripped, {_quote(pattern)})")
    + (" AND is_header" if (label, pattern) in rules.HEADER_ONLY_FLAGS else "")
    for label, pattern in rules.RED_FLAGS + rules.HEADER_ONLY_FLAGS
)
VIEWS["flag_hits"] = f"SELECT path, line_no, rule, substr(trim(raw), 1, 100) AS snippet FROM ({_RULE_TESTS}) u"
VIEWS["reach_hits"] = """SELECT path, line_no, '../ includes from header' AS rule, trim(raw) AS snippet
  FROM code_lines WHERE is_header AND tpl = 2"""


def _totals(hits: str) -> str:
    return f"""SELECT rule, count(*) AS hits, count(DISTINCT path) AS files,
      string_agg(path || ':' || line_no || '  ' || snippet, chr(10) ORDER BY rn) FILTER (WHERE rn <= 3) AS samples
    FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line_no) AS rn FROM {hits}) h GROUP BY rule"""


_INC = "tpl IN (0, 1, 2, 32, 33)"
_TARGET = "regexp_extract(raw, '[<\"]([^>\"]+)[>\"]', 1)"
VIEWS["hygiene_hits"] = f"""
SELECT path, 0 AS line_no, CASE WHEN bool_or(tpl = 38) THEN '#ifdef guard (no #pragma once)' ELSE 'header missing include guard' END AS rule,
  '' AS snippet FROM code_lines WHERE is_header GROUP BY path HAVING NOT bool_or(tpl = 3)
UNION ALL
SELECT path, 0, 'self-header not first include', 'first include is ' || target FROM (
  SELECT path, fid, arg_min({_TARGET}, line_no) AS target FROM code_lines WHERE {_INC} GROUP BY path, fid) f
WHERE fid % 3 = 1 AND EXISTS (SELECT 1 FROM code_lines h WHERE h.fid = f.fid - 1)
  AND regexp_replace(regexp_replace(target, '^.*/', ''), '\\.[^.]*$', '') <> 'f' || CAST(fid // 3 AS VARCHAR)
UNION ALL
SELECT path, line_no, 'code before first include', substr(trim(raw), 1, 80) FROM (
  SELECT *, min(CASE WHEN {_INC} THEN line_no END) OVER (PARTITION BY path) AS inc,
    row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn
  FROM code_lines WHERE is_header AND (({_INC}) OR (trim(stripped) <> '' AND trim(stripped) NOT LIKE '#%'))) c
WHERE rn = 1 AND inc > line_no
UNION ALL
SELECT path, min(line_no), 'unsorted includes', arg_min(substr(trim(raw), 1, 80), line_no) FROM (
  SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS run,
    lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS pl, lag(raw) OVER (PARTITION BY path ORDER BY line_no) AS pr
  FROM code_lines WHERE is_header AND {_INC}) r
WHERE pl = line_no - 1 AND (strpos(raw, '<') > 0) = (strpos(pr, '<') > 0)
  AND lower({_TARGET}) < lower(regexp_extract(pr, '[<"]([^>"]+)[>"]', 1)) GROUP BY path, run"""

VIEWS["spans"] = """
WITH d AS (SELECT path, line_no, loc, tpl, stripped,
    sum(len(stripped) - len(replace(stripped, '{', '')) - len(stripped) + len(replace(stripped, '}', '')))
      OVER (PARTITION BY path ORDER BY line_no) AS depth FROM code_lines WHERE NOT is_header),
  s AS (SELECT a.path, a.line_no AS start, a.loc, a.tpl, a.depth - 1 AS base FROM d a WHERE a.tpl IN (4, 25, 37) AND trim(a.stripped) <> ''),
  e AS (SELECT s.path, s.start, s.tpl, s.loc, min(d.line_no) AS fin FROM s LEFT JOIN d
    ON d.path = s.path AND d.line_no > s.start AND d.depth <= s.base GROUP BY ALL),
  n AS (SELECT *, coalesce(fin, loc) AS stop FROM e),
  o AS (SELECT *, max(stop) OVER (PARTITION BY path ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM n)
SELECT path, start, CASE tpl WHEN 4 THEN 'run' WHEN 25 THEN 'load_all' ELSE 'maxValue' END AS name, stop - start + 1 AS length
FROM o WHERE (covered IS NULL OR start > covered) AND stop - start + 1 >= 3"""

VIEWS["stats"] = f"""
SELECT path, count(*) AS loc, count(*) FILTER (WHERE {_INC} AND trim(stripped) <> '') AS includes,
  count(*) FILTER (WHERE tpl IN (7, 34)) AS todos, max(fid) AS fid FROM code_lines GROUP BY path"""
VIEWS["changes"] = f"""
SELECT {_FILE.replace('fid', '(event_id % 200)')} AS path, ts AS committed_at, event_id FROM events"""


@query(
    "read_corpus",
    "SELECT path, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM code_lines GROUP BY path",
)
def _(spark, sf):
    # beside the sources: a binary, a foreign folder and a large file of another kind
    others = small_table(
        spark,
        ["path", "text"],
        [("src/blob.cpp", "a\0b"), ("node_modules/x/dep.cpp", "int a;\n"), ("notes.txt", "x" * 100_000)],
    )
    out = fresh_dir(spark, "read_corpus")
    sinks.write_files(views.corpus(spark, sf).unionByName(others), out)
    return readers.read_corpus(spark, out).select(
        "path",
        F.octet_length("text").cast("bigint").alias("bytes"),
        F.size(C.split_lines(F.col("text"))).cast("bigint").alias("lines"),
    )


@query("explode_code_lines", "SELECT path, line_no, raw, is_header, loc FROM code_lines")
def _(spark, sf):
    return lines(spark, sf).select("path", "line_no", "raw", "is_header", "loc")


@query("strip_comments", "SELECT path, line_no, stripped FROM code_lines")
def _(spark, sf):
    return lines(spark, sf).select("path", "line_no", "stripped")


@query("todo_lines", "SELECT path, line_no, raw AS snippet FROM code_lines WHERE tpl IN (7, 34)")
def _(spark, sf):
    return ops.todo_lines(lines(spark, sf))


@query("red_flag_scan", "SELECT path, line_no, rule, snippet FROM flag_hits")
def _(spark, sf):
    return ops.red_flag_scan(lines(spark, sf))


@query(
    "red_flag_rules",
    r"""SELECT path, line_no, rule, snippet FROM flag_hits UNION ALL
      SELECT path, line_no, 'constant of part ' || p_partkey, substr(trim(raw), 1, 100) FROM part JOIN (
        SELECT path, line_no, raw, TRY_CAST(regexp_extract(stripped, '\b(kMax|q|k|z) = ([0-9]+)\b', 2) AS BIGINT) AS v FROM code_lines) c
        ON v = p_partkey
      UNION ALL SELECT path, line_no, 'width ' || p_size, substr(trim(raw), 1, 100)
        FROM (SELECT DISTINCT p_size FROM part) s JOIN code_lines ON regexp_matches(stripped, 'uint' || p_size || '_t')""",
)
def _(spark, sf):
    """The red flags, one rule per part and one per size, as a table."""
    own = [(*r, False) for r in rules.RED_FLAGS] + [(*r, True) for r in rules.HEADER_ONLY_FLAGS]
    table = small_table(spark, ["rule", "pattern", "header_only"], own)
    part = views.table(spark, sf, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    parts = part.select(
        F.concat(F.lit("constant of part "), key).alias("rule"),
        F.concat(F.lit(r"\b(?:kMax|q|k|z) = "), key, F.lit(r"\b")).alias("pattern"),
        F.lit(False).alias("header_only"),
    )
    sizes = part.select(
        F.concat(F.lit("width "), size).alias("rule"),
        F.concat(F.lit("uint"), size, F.lit("_t")).alias("pattern"),
        F.lit(False).alias("header_only"),
    ).distinct()
    return ops.red_flag_scan(lines(spark, sf), table.unionByName(parts).unionByName(sizes))


@query("red_flag_totals", _totals("flag_hits"))
def _(spark, sf):
    return ops.hit_totals(ops.red_flag_scan(lines(spark, sf)))


@query("reach_out_includes", _totals("reach_hits"))
def _(spark, sf):
    return ops.hit_totals(ops.reach_out_includes(lines(spark, sf)))


@query("printf_spec_scan", "SELECT path, line_no, raw AS snippet FROM code_lines WHERE tpl = 12")
def _(spark, sf):
    return ops.printf_spec_scan(lines(spark, sf)).select("path", "line_no", "snippet")


@query("guard_style", "SELECT path, rule FROM hygiene_hits WHERE rule LIKE '%guard%'")
def _(spark, sf):
    return ops.guard_style(views.corpus(spark, sf))


@query("code_before_include", "SELECT path, line_no, snippet FROM hygiene_hits WHERE rule LIKE 'code before%'")
def _(spark, sf):
    return ops.code_before_include(lines(spark, sf)).select("path", "line_no", "snippet")


@query("unsorted_includes", "SELECT path, line_no, snippet FROM hygiene_hits WHERE rule = 'unsorted includes'")
def _(spark, sf):
    return ops.unsorted_includes(lines(spark, sf)).select("path", "line_no", "snippet")


@query("self_header_first", "SELECT path, substr(snippet, 18) AS first_include FROM hygiene_hits WHERE rule LIKE 'self-header%'")
def _(spark, sf):
    return ops.self_header_first(views.corpus(spark, sf))


@query("header_hygiene_totals", _totals("hygiene_hits"))
def _(spark, sf):
    scan = ops.scan_lines(views.corpus(spark, sf))
    return ops.hit_totals(stored(ops.scan_hygiene(scan), "hygiene"))


_CLASSES = """SELECT path, line_no, CASE tpl WHEN 20 THEN 'Widget' ELSE 'Pod' END AS name FROM (
    SELECT *, lead(stripped) OVER (PARTITION BY path ORDER BY line_no) AS nxt FROM code_lines) c
  WHERE is_header AND ((tpl = 22 AND stripped = 'struct Pod {') OR (tpl = 20 AND stripped = 'class Widget' AND starts_with(ltrim(nxt), '{')))"""


@query("header_class_rows", _CLASSES)
def _(spark, sf):
    return ops.header_class_rows(lines(spark, sf))


@query(
    "multi_class_headers",
    f"SELECT path, count(*) AS classes, string_agg(name, ',' ORDER BY line_no) AS names FROM ({_CLASSES}) k GROUP BY path HAVING count(*) >= 2",
)
def _(spark, sf):
    return ops.multi_class_headers(ops.header_class_rows(lines(spark, sf)))


@query("function_spans", "SELECT path, start, name, length FROM spans")
def _(spark, sf):
    return spans(spark, sf)


_STYLES = "SELECT CASE name WHEN 'run' THEN 'lowercase' WHEN 'load_all' THEN 'snake_case' ELSE 'camelCase' END AS style, count(*) AS functions FROM spans GROUP BY 1"


@query("naming_distribution", f"SELECT style, functions, functions <= 0.25 * max(functions) OVER () AS minority FROM ({_STYLES}) s")
def _(spark, sf):
    return ops.naming_distribution(spans(spark, sf))


@query(
    "name_style",
    """SELECT url, CASE WHEN strpos(n, '_') > 0 THEN CASE WHEN lower(n) = n AND upper(n) <> n THEN 'snake_case' ELSE 'mixed_case' END
      WHEN upper(n) = n AND lower(n) <> n THEN 'UPPER_CASE'
      WHEN lower(n) <> n THEN CASE WHEN upper(substr(n, 1, 1)) = substr(n, 1, 1) AND lower(substr(n, 1, 1)) <> substr(n, 1, 1) THEN 'PascalCase' ELSE 'camelCase' END
      ELSE 'lowercase' END AS style FROM (
        SELECT url, CASE page_id % 5 WHEN 0 THEN w WHEN 1 THEN upper(w) WHEN 2 THEN w || '_' || w WHEN 3 THEN w || upper(w) ELSE upper(w) || '_' || w END AS n
        FROM (SELECT *, regexp_extract(url, '([a-z]+)\\.example', 1) AS w FROM pages) a) b""",
)
def _(spark, sf):
    word, key = F.regexp_extract("url", r"([a-z]+)\.example", 1), F.col("page_id") % 5
    name = (
        F.when(key == 0, word)
        .when(key == 1, F.upper(word))
        .when(key == 2, F.concat(word, F.lit("_"), word))
        .when(key == 3, F.concat(word, F.upper(word)))
        .otherwise(F.concat(F.upper(word), F.lit("_"), word))
    )
    return views.table(spark, sf, "pages").select("url", C.name_style(name).alias("style"))


@query(
    "member_naming_counts",
    """SELECT '_member (leading _)' AS rule, count(*) FILTER (WHERE live AND tpl = 15) AS n FROM l
      UNION ALL SELECT 'member_ (trailing _)', count(*) FILTER (WHERE live AND tpl = 15) FROM l
      UNION ALL SELECT 'm_member (m_ prefix)', count(*) FILTER (WHERE live AND tpl = 15) FROM l""".replace(
        "FROM l", "FROM (SELECT tpl, trim(stripped) <> '' AS live FROM code_lines) l"
    ),
)
def _(spark, sf):
    return ops.member_naming_counts(lines(spark, sf))


@query(
    "member_naming_samples",
    """SELECT rule, path, line_no, name FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line_no) AS rn FROM (
      SELECT path, line_no, unnest(['_member (leading _)', 'member_ (trailing _)', 'm_member (m_ prefix)']) AS rule,
        unnest(['_y', 'x_', 'm_value']) AS name FROM code_lines WHERE tpl = 15 AND trim(stripped) <> '') m) r WHERE rn <= 3""",
)
def _(spark, sf):
    return ops.member_naming_samples(lines(spark, sf))


@query(
    "function_naming_samples",
    """SELECT path, start, name, CASE name WHEN 'run' THEN 'lowercase' WHEN 'load_all' THEN 'snake_case' ELSE 'camelCase' END AS style
      FROM spans ORDER BY path, start LIMIT 8""",
)
def _(spark, sf):
    return ops.function_naming_samples(spans(spark, sf))


# Output-like templates: 12 prints, 13 logs; keys inside the literals of every
# template: status= and n= (too short to count) in 12, "url:" in 13.
VIEWS["log_keys"] = """
SELECT path, line_no, key, sep FROM (
  SELECT *, bool_or(tpl IN (12, 13)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS live
  FROM code_lines) c JOIN (VALUES (12, 'status', '='), (13, 'url', ':')) k(tpl, key, sep) ON k.tpl = c.tpl WHERE live"""


@query("log_field_scan", "SELECT path, line_no, key, sep AS separator, 'lowercase' AS style FROM log_keys")
def _(spark, sf):
    return ops.log_field_scan(lines(spark, sf))


@query(
    "log_field_style",
    "SELECT 'separator' AS kind, sep AS label, count(*) AS n FROM log_keys GROUP BY sep UNION ALL SELECT 'style', 'lowercase', count(*) FROM log_keys",
)
def _(spark, sf):
    return ops.log_field_style(ops.log_field_scan(lines(spark, sf)))


@query("top_log_keys", "SELECT key, count(*) AS n FROM log_keys GROUP BY key ORDER BY n DESC, key LIMIT 12")
def _(spark, sf):
    return ops.top_log_keys(ops.log_field_scan(lines(spark, sf)))


VIEWS["build_rows"] = """
SELECT p_size AS size FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 3 < 2"""
VIEWS["build_found"] = """
SELECT category, label, n FROM (
  SELECT 'warnings' AS category, '-Wall' AS label, count(*) AS n FROM build_rows
  UNION ALL SELECT 'warnings', '-Wextra', count(*) FROM build_rows
  UNION ALL SELECT 'warnings', 'MSVC /W4 /Wall', count(*) FILTER (WHERE size % 5 = 0) FROM build_rows
  UNION ALL SELECT 'warnings-as-errors', '-Werror (all)', count(*) FILTER (WHERE size % 4 = 0) FROM build_rows
  UNION ALL SELECT 'warnings-as-errors', '-Werror=specific', count(*) FILTER (WHERE size % 5 = 0) FROM build_rows
  UNION ALL SELECT 'warnings-as-errors', 'MSVC /WX', count(*) FILTER (WHERE size % 5 = 0) FROM build_rows
  UNION ALL SELECT 'strict', '-Wshadow', count(*) FILTER (WHERE size % 4 = 0) FROM build_rows
  UNION ALL SELECT 'hardening', '-fstack-protector*', count(*) FILTER (WHERE size % 7 = 0) FROM build_rows
  UNION ALL SELECT 'hardening', '-D_FORTIFY_SOURCE', count(*) FILTER (WHERE size % 7 = 0) FROM build_rows
  UNION ALL SELECT 'global-state (§7 anti-pattern)', 'add_compile_options/add_definitions', count(*) FILTER (WHERE size % 4 = 0) FROM build_rows
  UNION ALL SELECT 'global-state (§7 anti-pattern)', 'set(CMAKE_CXX_FLAGS ...)', count(*) FROM build_rows) b WHERE n > 0"""


def builds(spark, sf):
    files = views.build_files(spark, sf)
    return files.where(readers.is_build_file(F.col("path")) & ~readers.in_skipped_folder(F.col("path")))


@query("build_flag_counts", "SELECT category, label, n, (SELECT count(*) FROM build_rows) AS files FROM build_found")
def _(spark, sf):
    return ops.build_flag_counts(builds(spark, sf))


@query(
    "missing_build_categories",
    f"""SELECT category, suggestion FROM (VALUES {', '.join(f"({_quote(c)}, {_quote(s)})" for c, s in rules.SUGGESTIONS.items())}) s(category, suggestion)
      WHERE category NOT IN (SELECT category FROM build_found)""",
)
def _(spark, sf):
    return ops.missing_build_categories(ops.build_flag_counts(builds(spark, sf)))


VIEWS["bypass"] = """
SELECT CASE tpl WHEN 19 THEN 'rand' WHEN 31 THEN 'crc' ELSE 'time' END AS facility,
  CASE tpl WHEN 18 THEN 'time()/std::time' WHEN 34 THEN 'chrono::steady_clock' WHEN 19 THEN 'std::mt19937 family' ELSE 'myCrc32' END AS origin,
  count(*) AS n FROM code_lines WHERE tpl IN (18, 19, 31, 34) AND trim(stripped) <> '' GROUP BY 1, 2"""


@query(
    "wrapper_bypass",
    "SELECT facility, origin, n, count(*) OVER (PARTITION BY facility) >= 2 AS mixed FROM bypass",
)
def _(spark, sf):
    return ops.wrapper_bypass(lines(spark, sf))


VIEWS["magic_lines"] = r"""
SELECT path, line_no, substr(trim(stripped), 1, 100) AS snippet, c FROM (SELECT *, len(regexp_extract_all(
    regexp_replace(' ' || stripped || ' ', '([^\w.])', '\1\1', 'g'), '[^\w."'']([0-9]{2,})[^\w.]')) AS c
  FROM code_lines WHERE trim(stripped) <> '' AND NOT regexp_matches(trim(stripped), '^(#|enum\b|((inline|static|extern)\s+)*(constexpr|const)\b)')) m
WHERE c > 0"""


@query("magic_number_counts", "SELECT path, CAST(sum(c) AS BIGINT) AS n FROM magic_lines GROUP BY path")
def _(spark, sf):
    return ops.magic_number_counts(lines(spark, sf))


@query(
    "magic_number_samples",
    """SELECT path, line_no, snippet FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn FROM magic_lines
      WHERE path IN (SELECT path FROM magic_lines GROUP BY path ORDER BY sum(c) DESC, path LIMIT 4)) m WHERE rn <= 3""",
)
def _(spark, sf):
    return ops.magic_number_samples(stored(ops.magic_number_lines(lines(spark, sf)), "magic"))


@query(
    "duplicate_blocks",
    r"""SELECT * FROM (WITH l AS (SELECT 'doc/' || doc_id AS path, unnest(string_split(text, chr(10))) AS raw,
          generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
        k AS (SELECT path, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM l),
        r AS (SELECT path, line_no, list(line) OVER w AS block, count(*) OVER w AS n FROM k WHERE line <> ''
          WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
        h AS (SELECT sha256(array_to_string(block, chr(10))) AS block, path, line_no FROM r WHERE n = 5)
      SELECT block, count(*) AS copies, count(DISTINCT path) AS files, min(path) AS first_path,
        (SELECT min(line_no) FROM h i WHERE i.block = h.block AND i.path = (SELECT min(path) FROM h j WHERE j.block = h.block)) AS first_line
      FROM h GROUP BY block HAVING count(*) > 1) z""",
)
def _(spark, sf):
    files = views.documents(spark, sf).select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text"
    )
    return ops.duplicate_blocks(files)


@query(
    "file_stats",
    "SELECT s.path, loc, includes, todos, coalesce(f.n, 0) AS functions FROM stats s LEFT JOIN (SELECT path, count(*) AS n FROM spans GROUP BY path) f ON f.path = s.path",
)
def _(spark, sf):
    return ops.file_stats(views.corpus(spark, sf), spans(spark, sf))


@query("corpus_totals", "SELECT count(*) AS scanned_files, CAST(sum(loc) AS BIGINT) AS total_loc FROM stats")
def _(spark, sf):
    return ops.corpus_totals(views.corpus(spark, sf))


_CHURN = f"""SELECT s.path, c.commits, s.loc, c.commits * least(s.loc, 3000) AS risk FROM stats s JOIN (
  SELECT path, count(*) AS commits FROM changes WHERE committed_at >= TIMESTAMP '{SINCE}' GROUP BY path) c ON c.path = s.path"""


@query("churn_x_size", _CHURN)
def _(spark, sf):
    stats = ops.file_stats(views.corpus(spark, sf))
    return ops.churn_x_size(stats, views.change_log(spark, sf), SINCE)


@query("top_files_by_size", "SELECT path, loc FROM stats ORDER BY loc DESC, path LIMIT 15")
def _(spark, sf):
    return ops.top_files_by_size(ops.file_stats(views.corpus(spark, sf)))


@query("longest_functions", "SELECT path, start, name, length FROM spans ORDER BY length DESC, path DESC, start DESC LIMIT 15")
def _(spark, sf):
    return ops.longest_functions(spans(spark, sf))


@query("include_heavy_headers", "SELECT path, includes FROM stats WHERE fid % 3 = 0 ORDER BY includes DESC, path LIMIT 15")
def _(spark, sf):
    return ops.include_heavy_headers(ops.file_stats(views.corpus(spark, sf)))


@query("todo_hotspots", "SELECT path, todos FROM stats WHERE todos > 0 ORDER BY todos DESC, path LIMIT 15")
def _(spark, sf):
    return ops.todo_hotspots(ops.file_stats(views.corpus(spark, sf)))


@query("coverage_gap", f"SELECT path FROM stats WHERE path NOT IN (SELECT path FROM changes WHERE committed_at >= TIMESTAMP '{READ_SINCE}')")
def _(spark, sf):
    read = views.change_log(spark, sf).where(F.col("committed_at") >= F.lit(READ_SINCE).cast("timestamp_ntz"))
    return ops.coverage_gap(views.corpus(spark, sf), read)


def _fixed(corpus):
    """The corpus after a round of fixes and one regression."""
    text = F.replace("text", F.lit("p == NULL"), F.lit("!p"))
    text = F.replace(text, F.lit("sleep_for(250);"), F.lit("wait(250); wait(NULL);"))
    text = F.replace(text, F.lit("free(p);"), F.lit("Foo* r = new Foo();"))
    return corpus.withColumn("text", text)


@query(
    "scan_delta",
    """SELECT * FROM (WITH b AS (SELECT 'red_flags' AS section, rule AS label, count(*) AS n FROM
        (SELECT rule FROM flag_hits UNION ALL SELECT rule FROM reach_hits) u GROUP BY rule
        UNION ALL SELECT 'header_hygiene', rule, count(*) FROM hygiene_hits GROUP BY rule),
      v AS (SELECT count(*) FILTER (WHERE tpl = 14) AS nulls, count(*) FILTER (WHERE tpl = 16) AS sleeps, count(*) FILTER (WHERE tpl = 11) AS frees
        FROM code_lines WHERE trim(stripped) <> ''),
      a AS (SELECT section, label, n AS before, CASE label WHEN 'NULL macro' THEN (SELECT sleeps FROM v) WHEN 'sleep calls' THEN 0
        WHEN 'malloc/free family' THEN 0 WHEN 'raw new' THEN n + (SELECT frees FROM v) ELSE n END AS after FROM b)
      SELECT section, label, before, after, after - before AS delta, CASE WHEN before = 0 THEN 'new' WHEN after = 0 THEN 'gone'
        WHEN after < before THEN 'better' WHEN after > before THEN 'worse' ELSE 'same' END AS change FROM a) z""",
)
def _(spark, sf):
    corpus = views.corpus(spark, sf)
    return ops.scan_delta(ops.section_counts(corpus), ops.section_counts(_fixed(corpus)))


@query(
    "iteration_trend",
    """SELECT name, round, metric, metric - first_value(metric) OVER w AS growth, metric - lag(metric) OVER w AS step FROM (
      SELECT event_type AS name, CAST(ts AS DATE) - DATE '2024-01-01' AS round, CAST(max(floor(value)) AS BIGINT) AS metric FROM events GROUP BY 1, 2) s
      WINDOW w AS (PARTITION BY name ORDER BY round)""",
)
def _(spark, sf):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    snapshots = (
        views.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("name"), day.alias("round"))
        .agg(F.max(F.floor("value")).cast("bigint").alias("metric"))
    )
    return ops.iteration_trend(snapshots)


_PRINTF = f"(SELECT path, line_no, {_quote(rules.PRINTF_FLAG)} AS rule, raw AS snippet FROM code_lines WHERE tpl = 12)"
_ALL_HITS = f"(SELECT * FROM flag_hits UNION ALL SELECT * FROM reach_hits UNION ALL SELECT * FROM {_PRINTF} p)"
# Name, rows, columns in output order, order columns ("-": largest number first).
_SECTIONS = [
    ("totals", ORACLES["corpus_totals"], "scanned_files total_loc", "#scanned_files"),
    ("top_files_by_size", ORACLES["top_files_by_size"], "path loc", "-loc path"),
    ("longest_functions", ORACLES["longest_functions"], "path start name length", "-length path #start"),
    ("include_heavy_headers", ORACLES["include_heavy_headers"], "path includes", "-includes path"),
    ("todo_hotspots", ORACLES["todo_hotspots"], "path todos", "-todos path"),
    ("churn_x_size", sql(f"SELECT * FROM ({_CHURN}) c ORDER BY risk DESC, path DESC LIMIT 15"), "path commits loc risk", "-risk path"),
    ("red_flags", sql(_totals(_ALL_HITS)), "rule hits files samples", "-hits rule"),
    ("header_hygiene", ORACLES["header_hygiene_totals"], "rule hits files samples", "-hits rule"),
    ("function_naming", ORACLES["naming_distribution"], "style functions minority", "-functions style"),
    ("function_naming_samples", ORACLES["function_naming_samples"], "path start name style", "path #start"),
    ("member_naming", ORACLES["member_naming_counts"], "rule n", "rule"),
    ("member_naming_samples", ORACLES["member_naming_samples"], "rule path line_no name", "rule path #line_no"),
    ("log_field_style", ORACLES["log_field_style"], "kind label n", "kind label"),
    ("top_log_keys", ORACLES["top_log_keys"], "key n", "-n key"),
    ("build_hardening", ORACLES["build_flag_counts"], "category label n files", "category label"),
    ("build_files", sql("SELECT count(*) AS files_scanned FROM build_rows"), "files_scanned", "#files_scanned"),
    ("missing_categories", ORACLES["missing_build_categories"], "category suggestion", "category"),
    (
        "runtime_cost",
        "SELECT * FROM (VALUES " + ", ".join(f"({_quote(c)}, {_quote(t)})" for c, t in rules.RUNTIME_COST.items()) + ") v(category, cost)",
        "category cost",
        "category",
    ),
    (
        "header_composition",
        f"SELECT * FROM ({ORACLES['multi_class_headers']}) m ORDER BY classes DESC, path LIMIT 10",
        "path classes names",
        "-classes path",
    ),
    ("wrapper_bypass", ORACLES["wrapper_bypass"], "facility origin n mixed", "facility -n origin"),
    ("magic_numbers", f"SELECT * FROM ({ORACLES['magic_number_counts']}) m ORDER BY n DESC, path LIMIT 10", "path n", "-n path"),
    ("magic_number_samples", ORACLES["magic_number_samples"], "path line_no snippet", "path #line_no"),
    ("magic_number_total", f"SELECT CAST(sum(n) AS BIGINT) AS total FROM ({ORACLES['magic_number_counts']}) m", "total", "#total"),
]


def _report_sql() -> str:
    parts = ["SELECT -1 AS section, '' AS place, '{' AS text", f"SELECT {3 * len(_SECTIONS)}, '', '}}'"]
    for i, (name, rows, columns, order) in enumerate(_SECTIONS):
        entry = "to_json({" + ", ".join(f"'{c}': {c}" for c in columns.split()) + "})"
        keys = [
            f"lpad(CAST(10000000000000000000000000000000000000::HUGEINT - {k[1:]} AS VARCHAR), 38, '0')"
            if k[0] == "-"
            else f"lpad(CAST({k[1:]} AS VARCHAR), 38, '0')"
            if k[0] == "#"
            else k
            for k in order.split()
        ]
        place = f"concat_ws(chr(1), {', '.join(keys)})"
        end = "  ]" if i == len(_SECTIONS) - 1 else "  ],"
        parts.append(f"SELECT {3 * i}, '', '  \"{name}\": ['")
        parts.append(f"SELECT {3 * i + 2}, '', '{end}'")
        parts.append(
            f"SELECT {3 * i + 1}, place, '    ' || entry || CASE WHEN place = max(place) OVER () THEN '' ELSE ',' END "
            f"FROM (SELECT {place} AS place, CAST({entry} AS VARCHAR) AS entry FROM ({rows}) r) q{i}"
        )
    return " UNION ALL ".join(parts)


@query("scan_report_json")
def _(spark, sf):
    return ops.scan_report_json(views.corpus(spark, sf), builds(spark, sf), views.change_log(spark, sf), SINCE)


ORACLES["scan_report_json"] = _report_sql()
