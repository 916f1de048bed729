"""Registered queries of the sheet cell and base64 families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions import b64
from opslens.functions import cells as C
from opslens.operators import cells as ops
from opslens.plans.oracle import VIEWS, sql
from opslens.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = sql(oracle)
        return build

    return register


VIEWS["cells"] = """
SELECT l_orderkey // 10 AS sheet, CAST(l_linenumber AS BIGINT) AS col, l_orderkey % 10 + 1 AS row_no,
  max(CASE WHEN l_partkey % 9 = 0 THEN 'text' WHEN l_partkey % 9 = 1 THEN ' true ' WHEN l_partkey % 97 = 2 THEN '#DIV/0!'
    ELSE CAST(l_partkey % 1000 AS VARCHAR) END) AS content
FROM lineitem GROUP BY 1, 2, 3"""
VIEWS["cell_values"] = """
SELECT *, CASE content WHEN 'text' THEN 'string' WHEN ' true ' THEN 'boolean' WHEN '#DIV/0!' THEN 'error' ELSE 'number' END AS kind,
  CASE WHEN content NOT IN ('text', ' true ', '#DIV/0!') THEN CAST(content AS DOUBLE) END AS num FROM cells"""
VIEWS["asked"] = "SELECT s.sheet, r.* FROM (SELECT DISTINCT o_orderkey // 10 AS sheet FROM orders) s, (VALUES " + ", ".join(
    f"('{i}', {min(a, c)}, {min(b, d)}, {max(a, c)}, {max(b, d)})" for i, a, b, c, d in views.RANGES
) + ") r(range_id, c1, r1, c2, r2)"
VIEWS["inside"] = """
SELECT a.sheet, a.range_id, c.row_no * 100 + c.col AS spot, c.kind, c.num, c.content FROM asked a
LEFT JOIN cell_values c ON c.sheet = a.sheet AND c.row_no BETWEEN a.r1 AND a.r2 AND c.col BETWEEN a.c1 AND a.c2"""


@query("type_cell_literal", "SELECT sheet, col, row_no, kind, num, CASE WHEN kind = 'boolean' THEN true END AS truth FROM cell_values")
def _(spark, sf):
    rows = ops.typed_cells(views.cells(spark, sf))
    return rows.select("sheet", "col", "row_no", "value.kind", "value.num", F.col("value.bool").alias("truth"))


@query(
    "cross_type_compare",
    """SELECT line_id, CASE WHEN a IN ('true', 'false') AND b IN ('true', 'false') THEN sign(CAST(a = 'true' AS INT) - CAST(b = 'true' AS INT))
      WHEN na IS NOT NULL AND nb IS NOT NULL AND NOT (a LIKE '"%' AND b LIKE '"%') THEN sign(na - nb)
      WHEN a LIKE '"%' AND b LIKE '"%' THEN CASE WHEN sa < sb THEN -1 WHEN sa > sb THEN 1 ELSE 0 END
      WHEN a LIKE '"%' THEN 1 ELSE -1 END AS outcome FROM (
      SELECT *, CASE a WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE TRY_CAST(sa AS DOUBLE) END AS na,
        CASE b WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE TRY_CAST(sb AS DOUBLE) END AS nb FROM (
        SELECT *, replace(a, '"', '') AS sa, replace(b, '"', '') AS sb FROM (
          SELECT event_id AS line_id,
            CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN CAST(user_id % 20 AS VARCHAR) WHEN 2 THEN '"' || event_type || '"' ELSE '"' || (user_id % 20) || '"' END AS a,
            CASE event_id // 4 % 4 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END WHEN 1 THEN CAST(event_id % 20 AS VARCHAR)
              WHEN 2 THEN '"click"' ELSE '"' || (event_id % 30) || '"' END AS b FROM events) p) q) r""",
)
def _(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")

    def value(kind, text, number, boolean):
        return F.struct(
            kind.alias("kind"), number.cast("double").alias("num"), text.alias("str"), boolean.alias("bool")
        )

    none = F.lit(None)
    left_kind = F.when(e % 4 == 0, "boolean").when(e % 4 == 1, "number").otherwise("string")
    left = value(
        left_kind,
        F.when(e % 4 == 2, F.col("event_type")).when(e % 4 == 3, (u % 20).cast("string")),
        F.when(e % 4 == 1, u % 20),
        F.when(e % 4 == 0, F.lit(True)),
    )
    k = F.expr("event_id div 4 % 4")
    right_kind = F.when(k == 0, "boolean").when(k == 1, "number").otherwise("string")
    right = value(
        right_kind,
        F.when(k == 2, "click").when(k == 3, (e % 30).cast("string")),
        F.when(k == 1, e % 20).otherwise(none),
        F.when(k == 0, u % 2 == 0),
    )
    rows = views.table(spark, sf, "events").select(e.alias("line_id"), left.alias("l"), right.alias("r"))
    return rows.select("line_id", C.compare(F.col("l"), F.col("r")).cast("bigint").alias("outcome"))


@query(
    "coerce_bool",
    "SELECT sheet, count(*) FILTER (WHERE kind = 'boolean' OR num <> 0) AS truthy, count(*) AS n FROM cell_values WHERE kind <> 'error' GROUP BY sheet",
)
def _(spark, sf):
    rows = ops.typed_cells(views.cells(spark, sf)).where(F.col("value.kind") != "error")
    return rows.groupBy("sheet").agg(F.count_if(C.truth(F.col("value"))).alias("truthy"), F.count(F.lit(1)).alias("n"))


@query(
    "cell_range_join",
    "SELECT sheet, range_id, content, spot FROM inside WHERE spot IS NOT NULL",
)
def _(spark, sf):
    inside = ops.cell_range_join(views.cells(spark, sf), views.ranges(spark, sf))
    return inside.select("sheet", "range_id", "content", (F.col("row_no") * 100 + F.col("col")).alias("spot"))


@query(
    "range_aggregate",
    """SELECT sheet, range_id, CASE WHEN e IS NULL THEN n END AS count, CASE WHEN e IS NULL THEN coalesce(s, 0) END AS sum,
      CASE WHEN e IS NULL THEN round(s / n, 6) END AS avg, CASE WHEN e IS NULL THEN lo END AS min, CASE WHEN e IS NULL THEN hi END AS max,
      e AS error, CASE WHEN e IS NULL AND n = 0 THEN '#VALUE!' END AS empty_error FROM (
      SELECT sheet, range_id, count(num) AS n, sum(num) AS s, min(num) AS lo, max(num) AS hi,
        arg_min(content, spot) FILTER (WHERE kind = 'error') AS e FROM inside GROUP BY sheet, range_id) g""",
)
def _(spark, sf):
    rows = ops.range_aggregate(views.cells(spark, sf), views.ranges(spark, sf))
    return rows.withColumn("avg", F.round("avg", 6))


@query(
    "range_logic",
    """SELECT sheet, range_id, CASE WHEN no_at < coalesce(err_at, 1e9) THEN 'FALSE' WHEN err_at IS NOT NULL THEN '#DIV/0!' ELSE 'TRUE' END AS all_true,
      CASE WHEN yes_at < coalesce(err_at, 1e9) THEN 'TRUE' WHEN err_at IS NOT NULL THEN '#DIV/0!' ELSE 'FALSE' END AS any_true FROM (
      SELECT sheet, range_id, min(spot) FILTER (WHERE kind = 'error') AS err_at,
        min(spot) FILTER (WHERE kind = 'string' OR num = 0) AS no_at, min(spot) FILTER (WHERE kind = 'boolean' OR num <> 0) AS yes_at
      FROM inside GROUP BY sheet, range_id) g""",
)
def _(spark, sf):
    return ops.range_logic(views.cells(spark, sf), views.ranges(spark, sf))


@query(
    "a1_ref",
    """SELECT DISTINCT c AS col, r AS row_no, CASE WHEN c > 26 THEN chr(CAST((c - 1) // 26 + 64 AS INTEGER)) ELSE '' END || chr(CAST((c - 1) % 26 + 65 AS INTEGER)) || r AS text
      FROM (SELECT l_partkey % 702 + 1 AS c, l_suppkey % 99 + 1 AS r FROM lineitem) x""",
)
def _(spark, sf):
    made = views.table(spark, sf, "lineitem").select(
        C.reference_text(F.col("l_partkey") % 702 + 1, F.col("l_suppkey") % 99 + 1).alias("text")
    )
    ref = C.reference(F.concat(F.lit("$"), F.lower("text")))
    return made.distinct().select(ref["col"].alias("col"), ref["row_no"].alias("row_no"), "text")


@query(
    "reference_edges",
    """SELECT sheet, col, row_no, to_col, to_row FROM (
      SELECT sheet, col, row_no, unnest([col, col % 7 + 1]) AS to_col, row_no + 1 AS to_row FROM cells WHERE row_no < 10
      UNION ALL SELECT sheet, col, row_no, col, 1 FROM cells WHERE row_no = 10 AND sheet % 7 = 0) e""",
)
def _(spark, sf):
    return ops.reference_edges(views.formulas(spark, sf))


# Cells are numbered row * 100 + column.  A cell that reaches a cell which reaches
# itself has no depth; the depth of the others grows upwards from the leaves.
VIEWS["formula_cells"] = "SELECT sheet, row_no * 100 + col AS a, col, row_no FROM cells WHERE row_no < 10 OR sheet % 7 = 0"
VIEWS["formula_refs"] = """
SELECT r.sheet, r.a, r.b FROM (
  SELECT sheet, a, unnest([(row_no + 1) * 100 + col, (row_no + 1) * 100 + col % 7 + 1]) AS b FROM formula_cells WHERE row_no < 10
  UNION ALL SELECT sheet, a, 100 + col FROM formula_cells WHERE row_no = 10) r
JOIN formula_cells f ON f.sheet = r.sheet AND f.a = r.b"""
VIEWS["reach"] = """
SELECT sheet, a, b FROM formula_refs UNION SELECT r.sheet, r.a, e.b FROM reach r JOIN formula_refs e ON e.sheet = r.sheet AND e.a = r.b"""
VIEWS["looping"] = """
SELECT DISTINCT r.sheet, r.a FROM reach r JOIN (SELECT sheet, a FROM reach WHERE a = b) s
  ON s.sheet = r.sheet AND (r.b = s.a OR r.a = s.a)"""
VIEWS["heights"] = """
SELECT sheet, a, 1 AS n FROM formula_cells f WHERE NOT EXISTS (SELECT 1 FROM formula_refs e WHERE e.sheet = f.sheet AND e.a = f.a)
UNION SELECT e.sheet, e.a, h.n + 1 FROM heights h JOIN formula_refs e ON e.sheet = h.sheet AND e.b = h.a
WHERE NOT EXISTS (SELECT 1 FROM looping l WHERE l.sheet = e.sheet AND l.a = e.a)"""


@query(
    "reference_graph",
    """SELECT f.sheet, f.col, f.row_no, max(h.n) AS depth, CASE WHEN max(h.n) IS NULL THEN 'cycle' ELSE 'ok' END AS state
      FROM formula_cells f LEFT JOIN heights h ON h.sheet = f.sheet AND h.a = f.a
        AND NOT EXISTS (SELECT 1 FROM looping l WHERE l.sheet = f.sheet AND l.a = f.a)
      GROUP BY f.sheet, f.col, f.row_no""",
)
def _(spark, sf):
    return ops.reference_graph(views.formulas(spark, sf))


VIEWS["b64"] = """
SELECT doc_id, source AS origin, p, strlen(p) AS n, right(p, 2) = '==' AS two, CASE WHEN doc_id % 6 = 1 THEN 'url'
  WHEN doc_id % 6 = 2 AND doc_id % 4 <> 0 THEN 'mime' WHEN doc_id % 6 = 5 AND doc_id % 5 <> 0 THEN 'lenient' ELSE 'strict' END AS mode
FROM (SELECT *, to_base64(encode(text)) AS p FROM documents) d"""


@query(
    "base64_columns",
    r"""SELECT doc_id, p AS standard, rtrim(replace(replace(p, '+', '-'), '/', '_'), '=') AS url,
      regexp_replace(regexp_replace(p, '(.{76})', '\1' || chr(13) || chr(10), 'g'), '\r\n$', '') AS mime FROM b64""",
)
def _(spark, sf):
    data = F.encode("text", "UTF-8")
    return views.documents(spark, sf).select(
        "doc_id", *[b64.encode(data, m).alias(m) for m in ("standard", "url", "mime")]
    )


VIEWS["b64_judged"] = """
SELECT doc_id, origin, mode, CASE doc_id % 6 WHEN 2 THEN CASE WHEN mode = 'strict' AND n > 76 THEN 'bad_character' ELSE 'valid' END
    WHEN 3 THEN 'bad_character' WHEN 4 THEN CASE WHEN two THEN 'incomplete_padding' ELSE 'missing_padding' END
    WHEN 5 THEN CASE WHEN mode = 'strict' THEN 'bad_character' ELSE 'valid' END ELSE 'valid' END AS class,
  CASE doc_id % 6 WHEN 2 THEN CASE WHEN mode = 'strict' AND n > 76 THEN 76 END WHEN 3 THEN 4
    WHEN 5 THEN CASE WHEN mode = 'strict' THEN 4 END END AS position FROM b64"""


@query("base64_audit", "SELECT doc_id, mode, class, CAST(position AS BIGINT) AS position FROM b64_judged")
def _(spark, sf):
    return b64.audit(views.b64_values(spark, sf)).select("doc_id", "mode", "class", "position")


@query("base64_class_counts", "SELECT origin, class, count(*) AS n FROM b64_judged GROUP BY origin, class")
def _(spark, sf):
    judged = b64.audit(views.b64_values(spark, sf))
    return judged.groupBy("origin", "class").agg(F.count(F.lit(1)).alias("n"))
