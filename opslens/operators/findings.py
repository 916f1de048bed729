"""Review findings, verdicts and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.text import strip_all

# Severities from worst to mildest and the verdicts.
SEVERITIES = ["Blocker", "Major", "Minor", "Nit"]
VERDICTS = ["accept", "reject", "discuss", "custom"]
REQUIRED = ["file", "title", "detail", "fix"]


def normalize_severity(severity: Column) -> Column:
    """Trimmed and capitalised; anything unknown is Minor."""
    word = F.initcap(F.lower(strip_all(severity)))
    return F.when(word.isin(*SEVERITIES), word).otherwise("Minor")


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)])
    return F.coalesce(F.try_element_at(ranks, severity), F.lit(9))


def _blank(text: Column) -> Column:
    return strip_all(F.coalesce(text, F.lit(""))) == ""


def validate_findings(findings: DataFrame) -> DataFrame:
    """One row per missing required field: ``review_id, id, rule``."""
    rules = F.array(*[F.when(_blank(F.col(c)), F.lit(f"missing {c}")) for c in REQUIRED])
    return findings.select("review_id", "id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def validate_documents(documents: DataFrame) -> DataFrame:
    """One row per document-level violation of ``document, review, summary, findings``."""
    coverage = strip_all(F.coalesce("review.coverage", F.lit("")))
    rules = F.array(
        F.when(_blank(F.col("review.scope")), "scope is empty"),
        F.when(F.length(coverage) < 8, "coverage is missing"),
        F.when(_blank(F.col("summary")), "summary is missing"),
        F.when(F.coalesce(F.size("findings"), F.lit(0)) <= 0, "no findings"),
    )
    return documents.select("document", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def auto_ids(items: DataFrame, letter: str) -> DataFrame:
    """A missing id becomes ``<letter><n>`` by 1-based position ``pos``."""
    made = F.concat(F.lit(letter), (F.col("pos") + 1).cast("string"))
    return items.withColumn("id", F.coalesce("id", made))


def effective_status(verdict: Column, comment: Column) -> Column:
    """The verdict, else ``discuss`` when there is a comment, else null."""
    return F.coalesce(F.nullif(verdict, F.lit("")), F.when(~_blank(comment), F.lit("discuss")))


def findings_with_verdicts(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Findings and feedback side by side; the feedback's copy of a finding stands in
    where the finding itself is gone.

    ``feedback`` holds ``id, verdict, comment`` and may hold copies of finding columns.
    """
    copies = [c for c in ("severity", "file", "line", "title", "fix") if c in feedback.columns]
    renamed = feedback.select("id", "verdict", "comment", *[F.col(c).alias(f"copy_{c}") for c in copies])
    joined = findings.withColumn("present", F.lit(True)).join(renamed, "id", "full")
    merged = {c: F.coalesce(F.col(c), F.col(f"copy_{c}")) for c in copies}
    merged["severity"] = normalize_severity(merged.get("severity", F.col("severity")))
    return (
        joined.withColumns(merged)
        .withColumns(
            {
                "present": F.coalesce("present", F.lit(False)),
                "status": effective_status(F.col("verdict"), F.col("comment")),
            }
        )
        .drop(*[f"copy_{c}" for c in copies])
    )


def filter_findings(judged: DataFrame, severity: str = "", status: str = "") -> DataFrame:
    """Rows of a severity and a status; ``none`` means undecided, blank means any."""
    wanted = F.lit(True)
    if severity:
        wanted = wanted & (F.col("severity") == severity)
    if status == "none":
        wanted = wanted & F.col("status").isNull()
    elif status:
        wanted = wanted & F.coalesce(F.col("status") == status, F.lit(False))
    return judged.where(wanted)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(
        normalize_severity(F.col("severity")).alias("severity"), "category"
    ).agg(F.count(F.lit(1)).alias("findings"))


def decision_progress(judged: DataFrame) -> DataFrame:
    decided = F.count_if(F.col("status").isNotNull())
    total = F.count(F.lit(1))
    return judged.groupBy("review_id").agg(
        total.alias("total"),
        decided.alias("decided"),
        (total - decided).alias("undecided"),
        (decided < total).alias("alert"),
    )


def verdict_group(status: Column, comment: Column) -> Column:
    """Fix-round group; ``custom`` without a comment is ``discuss``."""
    return F.when((status == "custom") & _blank(comment), "discuss").otherwise(status)


def verdict_groups(judged: DataFrame) -> DataFrame:
    """One row per decided finding with its group; the groups may be large, so their
    members stay rows."""
    return judged.where(F.col("status").isNotNull()).select(
        "review_id", "id", verdict_group(F.col("status"), F.col("comment")).alias("verdict_group")
    )


def module_of(path: Column) -> Column:
    """Folder of a path."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def systemic_patterns(findings: DataFrame, least: int = 2, examples: int = 3) -> DataFrame:
    """Repeated issue classes: ``category, title, n, modules, worst_module, examples``."""
    keyed = findings.where(~_blank(F.col("title"))).withColumn("module", module_of(F.col("file")))
    per_module = keyed.groupBy("category", "title", "module").agg(F.count(F.lit(1)).alias("n"))
    counted = per_module.groupBy("category", "title").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("modules"),
        F.min(F.struct((-F.col("n")).alias("n"), "module")).alias("worst"),
    )
    order = Window.partitionBy("category", "title").orderBy("file", F.coalesce("line", F.lit(0)), "id")
    where = F.concat(F.col("file"), F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"))
    shown = (
        keyed.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= examples)
        .groupBy("category", "title")
        .agg(F.array_sort(F.collect_list(F.struct("rank", where.alias("at")))).alias("first"))
    )
    return (
        counted.where(F.col("n") >= least)
        .join(shown, ["category", "title"])
        .select("category", "title", "n", "modules", F.col("worst.module").alias("worst_module"),
                F.array_join(F.col("first.at"), ",").alias("examples"))
    )


def rank_findings(findings: DataFrame) -> DataFrame:
    """Report order: severity, file, line (missing line first)."""
    ranked = findings.withColumn("rank", severity_rank(normalize_severity(F.col("severity"))))
    return ranked.orderBy("rank", "file", F.coalesce("line", F.lit(0)), "id")


def cap_nits(findings: DataFrame, cap: int = 10) -> DataFrame:
    """All findings, but at most ``cap`` nits per review, first by file and line."""
    severity = normalize_severity(F.col("severity"))
    order = Window.partitionBy("review_id").orderBy("file", F.coalesce("line", F.lit(0)), "id")
    nits = (
        findings.where(severity == "Nit")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= cap)
        .drop("rank")
    )
    return findings.where(severity != "Nit").unionByName(nits)


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per file, line and category: the worst, then the earliest batch.

    The winner is an aggregate, so copies meet map-side and none is shuffled twice.
    """
    rank = severity_rank(normalize_severity(F.col("severity")))
    others = [c for c in findings.columns if c not in ("file", "line", "category")]
    best = F.min_by(F.struct(*others), F.struct(rank, "review_id", "id")).alias("best")
    return findings.groupBy("file", "line", "category").agg(best).select(
        "file", "line", "category", *[F.col(f"best.{c}").alias(c) for c in others]
    )


def finding_precision_recall(reported: DataFrame, expected: DataFrame, bucket: int = 10) -> DataFrame:
    """Reported against expected findings, matched by file, category and line bucket:
    ``true_positive, false_positive, missed, precision, recall``."""

    def places(df: DataFrame, mark: str) -> DataFrame:
        place = F.floor(F.coalesce("line", F.lit(0)) / bucket).cast("bigint").alias("place")
        return df.select("file", "category", place).distinct().withColumn(mark, F.lit(1))

    both = places(reported, "reported").join(places(expected, "expected"), ["file", "category", "place"], "full")
    hit = F.col("reported").isNotNull() & F.col("expected").isNotNull()
    counts = both.agg(
        F.count_if(hit).alias("true_positive"),
        F.count_if(F.col("expected").isNull()).alias("false_positive"),
        F.count_if(F.col("reported").isNull()).alias("missed"),
    )
    hits = F.col("true_positive")
    return counts.select(
        "*",
        F.round(hits / F.nullif(hits + F.col("false_positive"), F.lit(0)), 4).alias("precision"),
        F.round(hits / F.nullif(hits + F.col("missed"), F.lit(0)), 4).alias("recall"),
    )
