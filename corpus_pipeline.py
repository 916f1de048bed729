"""The corpus pipeline: quality rules, near-duplicate join, decontamination, mixing, packed tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept; ``run``
writes each stage's rows to the shared folder and reads them back as the next one's input.

Odd rows: documents without words fail the base rules of the first stage; later stages by themselves
keep them (they resemble nothing, hold no item and have no words to mix, and pack as their end id).  Rows
without id or source are documents like any other.  Repeated rows are judged alike; the near-duplicate
stage leaves one row of each id it keeps, and all rows without words or id.  Further columns of any name pass through; an empty
table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opslens.llm import bitpack, decontaminate, jaccard_join, mixing, perplexity
from opslens.llm.shared import written
from opslens.llm.tables import table, vocabulary_path

# SQL has no n-gram model, alignment or tokenizer, so the stages are tested against brute force.
ORACLE_SQL = None
#: Near duplicates share so much of their shingles of so many words; op7 by itself is fixed at 4 words and 85 %.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band."""
    return perplexity.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word similarity of 0.8 joins: the one with the least id."""
    return jaccard_join.keep_first(docs, percent=NEAR_PERCENT, size=NEAR_SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents in packed files, digested from the files."""
    return bitpack.pack_documents(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("packed_tokens", packed_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
