"""From raw documents to sampled piece ids, in five stages.

Each stage takes (spark, docs, sf_dir), reads all that the one before it kept, and returns a
DataFrame; ``run`` writes it as Parquet in the shared folder, reads it again for the next, and
deletes what went into it.  A stage leaves no copy of the texts there: rows that go are left out by
number.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm.decontaminate import drop_contaminated
from wayfold.llm.near_dedup import drop_near_duplicates
from wayfold.llm.pieces import encode_pieces
from wayfold.llm.quality_rules import keep_good
from wayfold.llm.secrets import redact_secrets
from wayfold.llm.tables import table
from wayfold.plans.staging import stage, unstage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return redact_secrets(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, and whether they decode to its text."""
    return encode_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: Learned rules, decoding and sampling have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        made = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            unstage(docs)
        docs = made
    return docs
