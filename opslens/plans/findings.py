"""Registered queries of the review findings family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.operators import findings as ops
from opslens.plans.oracle import VIEWS, sql
from opslens.session import fresh_dir
from opslens.sources import readers, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = sql(oracle)
        return build

    return register


VIEWS["findings"] = """
SELECT l_orderkey // 100 AS review_id, 'L-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
  l_partkey AS pk, ['blocker', 'MAJOR', ' minor ', 'Nit', 'weird', 'Minor'][CAST(l_partkey % 6 + 1 AS BIGINT)] AS written,
  ['Blocker', 'Major', 'Minor', 'Nit', 'Minor', 'Minor'][CAST(l_partkey % 6 + 1 AS BIGINT)] AS severity,
  [0, 1, 2, 3, 2, 2][CAST(l_partkey % 6 + 1 AS BIGINT)] AS rk,
  ['concurrency', 'api', 'headers', 'testing'][CAST(l_suppkey % 4 + 1 AS BIGINT)] AS category,
  'src/mod' || (l_suppkey % 9) AS module, 'src/mod' || (l_suppkey % 9) || '/a' || (l_partkey % 200) || '.cpp' AS file,
  CASE WHEN l_partkey % 10 <> 0 THEN l_partkey % 50 END AS line,
  CASE WHEN l_partkey % 41 = 0 THEN '' ELSE 't' || (l_partkey % 30) END AS title,
  CASE WHEN l_partkey % 43 = 0 THEN ' ' ELSE 'fix it' END AS fix,
  CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'reject' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'custom' ELSE '' END END AS verdict,
  CASE WHEN l_suppkey % 3 = 0 THEN 'note' ELSE '' END AS comment
FROM lineitem"""
VIEWS["judged"] = """
SELECT *, CASE WHEN pk % 4 = 0 THEN NULL WHEN verdict <> '' THEN verdict WHEN comment <> '' THEN 'discuss' END AS status FROM findings"""


def findings(spark, sf):
    return views.findings(spark, sf)


def judged(spark, sf):
    return ops.findings_with_verdicts(findings(spark, sf), views.verdicts(spark, sf))


@query(
    "validate_findings",
    """SELECT review_id, id, rule FROM (SELECT review_id, id, unnest([CASE WHEN title = '' THEN 'missing title' END,
      CASE WHEN trim(fix) = '' THEN 'missing fix' END]) AS rule FROM findings) x WHERE rule IS NOT NULL""",
)
def _(spark, sf):
    return ops.validate_findings(findings(spark, sf))


@query("normalize_severity", "SELECT written, severity, count(*) AS n FROM findings GROUP BY written, severity")
def _(spark, sf):
    severity = F.col("severity")
    return (
        findings(spark, sf)
        .groupBy(severity.alias("written"), ops.normalize_severity(severity).alias("severity"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("effective_status", "SELECT id, status FROM judged")
def _(spark, sf):
    rows = views.verdicts(spark, sf)
    return rows.select("id", ops.effective_status(F.col("verdict"), F.col("comment")).alias("status"))


@query("filter_findings", "SELECT id, category FROM judged WHERE severity = 'Major' AND status IS NULL")
def _(spark, sf):
    return ops.filter_findings(judged(spark, sf), "Major", "none").select("id", "category")


@query(
    "findings_with_verdicts",
    """SELECT id, severity, file, CASE WHEN pk % 7 <> 0 THEN status END AS status, true AS present FROM judged
      UNION ALL SELECT 'old-' || id, severity, file, status, false FROM judged WHERE pk % 7 = 0""",
)
def _(spark, sf):
    # one verdict in seven is about a finding that has another id now
    part = F.split("id", "-")[3].cast("bigint")
    copies = findings(spark, sf).select("id", "severity", "file", "line", "title", "fix")
    feedback = views.verdicts(spark, sf).join(copies, "id")
    feedback = feedback.withColumn("id", F.when(part % 7 == 0, F.concat(F.lit("old-"), F.col("id"))).otherwise(F.col("id")))
    merged = ops.findings_with_verdicts(findings(spark, sf), feedback)
    return merged.select("id", "severity", "file", "status", "present")


@query("severity_counts", "SELECT severity, category, count(*) AS findings FROM findings GROUP BY severity, category")
def _(spark, sf):
    return ops.severity_counts(findings(spark, sf))


@query(
    "decision_progress",
    """SELECT review_id, count(*) AS total, count(status) AS decided, count(*) - count(status) AS undecided,
      count(status) < count(*) AS alert FROM judged GROUP BY review_id""",
)
def _(spark, sf):
    return ops.decision_progress(judged(spark, sf))


@query(
    "verdict_groups",
    """SELECT review_id, id, CASE WHEN status = 'custom' AND comment = '' THEN 'discuss' ELSE status END AS verdict_group
      FROM judged WHERE status IS NOT NULL""",
)
def _(spark, sf):
    return ops.verdict_groups(judged(spark, sf))


@query(
    "systemic_patterns",
    """SELECT * FROM (WITH m AS (SELECT category, title, module, count(*) AS n FROM findings WHERE title <> '' GROUP BY ALL),
      c AS (SELECT category, title, CAST(sum(n) AS BIGINT) AS n, count(*) AS modules, arg_min(module, (-n, module)) AS worst_module FROM m GROUP BY ALL),
      e AS (SELECT category, title, file || ':' || coalesce(line, 0) AS at,
        row_number() OVER (PARTITION BY category, title ORDER BY file, coalesce(line, 0), id) AS rn FROM findings WHERE title <> '')
      SELECT c.category, c.title, c.n, c.modules, c.worst_module, string_agg(e.at, ',' ORDER BY rn) AS examples
      FROM c JOIN e ON e.category = c.category AND e.title = c.title AND rn <= 3 WHERE c.n >= 2 GROUP BY ALL) z""",
)
def _(spark, sf):
    return ops.systemic_patterns(findings(spark, sf))


@query(
    "auto_ids",
    """SELECT o_orderkey // 100 AS review_id, CAST(o_orderkey % 100 AS BIGINT) AS pos,
      CASE WHEN o_custkey % 3 = 0 THEN 'F' || CAST(o_orderkey % 100 + 1 AS VARCHAR) ELSE 'X' || o_custkey END AS id FROM orders""",
)
def _(spark, sf):
    items = views.table(spark, sf, "orders").select(
        F.expr("o_orderkey div 100").alias("review_id"),
        (F.col("o_orderkey") % 100).alias("pos"),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("X"), F.col("o_custkey").cast("string"))).alias("id"),
    )
    return ops.auto_ids(items, "F")


@query("rank_findings", "SELECT id, CAST(rk AS BIGINT) AS rank, file, line FROM findings ORDER BY rk, file, coalesce(line, 0), id")
def _(spark, sf):
    return ops.rank_findings(findings(spark, sf)).select("id", F.col("rank").cast("bigint").alias("rank"), "file", "line")


@query(
    "cap_nits",
    """SELECT review_id, id FROM (SELECT *, row_number() OVER (PARTITION BY review_id, severity = 'Nit' ORDER BY file, coalesce(line, 0), id) AS rn
      FROM findings) x WHERE severity <> 'Nit' OR rn <= 10""",
)
def _(spark, sf):
    return ops.cap_nits(findings(spark, sf)).select("review_id", "id")


@query(
    "dedupe_findings",
    """SELECT file, line, category, id, review_id FROM (SELECT *, row_number() OVER (PARTITION BY file, line, category
      ORDER BY rk, review_id, id) AS rn FROM findings) x WHERE rn = 1""",
)
def _(spark, sf):
    return ops.dedupe_findings(findings(spark, sf)).select("file", "line", "category", "id", "review_id")


@query(
    "finding_precision_recall",
    """SELECT tp AS true_positive, fp AS false_positive, fn AS missed, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision,
      round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall FROM (
      SELECT count(*) FILTER (WHERE r AND e) AS tp, count(*) FILTER (WHERE r AND NOT e) AS fp, count(*) FILTER (WHERE e AND NOT r) AS fn FROM (
        SELECT file, category, coalesce(line, 0) // 10 AS place, bool_or(severity IN ('Blocker', 'Major')) AS r, bool_or(coalesce(status = 'accept', false)) AS e
        FROM judged GROUP BY 1, 2, 3) g WHERE r OR e) c""",
)
def _(spark, sf):
    rows = judged(spark, sf)
    return ops.finding_precision_recall(
        rows.where(F.col("severity").isin("Blocker", "Major")), rows.where(F.col("status") == "accept")
    )


def _document(spark, sf):
    """One findings document per order, written as a line of JSON and read back."""
    rows = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.struct(
            F.struct(
                F.concat(F.lit("demo-"), F.col("o_orderkey").cast("string")).alias("repo"),
                F.when(F.col("o_custkey") % 5 == 0, "").otherwise("whole").alias("scope"),
                F.when(F.col("o_custkey") % 7 == 0, "short").otherwise("all modules read").alias("coverage"),
            ).alias("review"),
            F.when(F.col("o_custkey") % 11 == 0, " ").otherwise("fine").alias("summary"),
            F.array(
                F.struct(F.lit("loop").alias("title"), F.lit(2).alias("count"), F.array(F.lit("a:1")).alias("examples"))
            ).alias("systemic"),
            F.array(
                F.struct(
                    F.lit("f1.cpp").alias("file"), F.col("o_custkey").alias("line"), F.lit("t").alias("title"),
                    F.lit("major ").alias("severity"), F.lit(None).cast("string").alias("id"),
                ),
                F.struct(
                    F.lit("f2.cpp").alias("file"), F.lit(None).cast("bigint").alias("line"), F.lit("u").alias("title"),
                    F.lit("odd").alias("severity"), F.concat(F.lit("Z"), F.col("o_orderkey").cast("string")).alias("id"),
                ),
            ).alias("findings"),
        ).alias("doc"),
    )
    out = fresh_dir(spark, "findings")
    rows.select("doc.*").write.json(out)
    read = readers.read_review_documents(spark, out, per_line=True)
    return read.withColumn("document", F.substring("review.repo", 6, 20).cast("bigint"))


@query(
    "read_findings",
    """SELECT o_orderkey AS document, u.id, u.severity, u.file, u.line FROM orders, LATERAL (
      SELECT 'F1' AS id, 'Major' AS severity, 'f1.cpp' AS file, o_custkey AS line
      UNION ALL SELECT 'Z' || o_orderkey, 'Minor', 'f2.cpp', NULL) u""",
)
def _(spark, sf):
    rows = readers.read_findings(_document(spark, sf))
    return rows.select("document", "id", ops.normalize_severity(F.col("severity")).alias("severity"), "file", "line")


@query("read_systemic", "SELECT o_orderkey AS document, 'S1' AS id, 'loop' AS title, 2 AS count FROM orders")
def _(spark, sf):
    return readers.read_systemic(_document(spark, sf)).select("document", "id", "title", "count")


@query(
    "validate_documents",
    """SELECT document, rule FROM (SELECT o_orderkey AS document, unnest([CASE WHEN o_custkey % 5 = 0 THEN 'scope is empty' END,
      CASE WHEN o_custkey % 7 = 0 THEN 'coverage is missing' END, CASE WHEN o_custkey % 11 = 0 THEN 'summary is missing' END]) AS rule
      FROM orders) x WHERE rule IS NOT NULL""",
)
def _(spark, sf):
    return ops.validate_documents(_document(spark, sf))


@query(
    "read_feedback",
    """SELECT id, CASE WHEN pk % 4 = 0 THEN '' ELSE verdict END AS verdict, CASE WHEN pk % 4 = 0 THEN '' ELSE comment END AS comment,
      severity FROM findings""",
)
def _(spark, sf):
    copies = findings(spark, sf).select("id", ops.normalize_severity(F.col("severity")).alias("severity"))
    rows = views.verdicts(spark, sf).join(copies, "id")
    out = fresh_dir(spark, "feedback")
    rows.select(F.create_map(F.col("id"), F.struct("verdict", "comment", "severity")).alias("verdicts")).write.json(out)
    return readers.read_feedback(spark, out, per_line=True).select("id", "verdict", "comment", "severity")
