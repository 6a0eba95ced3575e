"""Reading the input tables, and the label fold that every learner here shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold: one row per doc_id, at most about ``max_rows``.

    Labels other than 0 and 1 are dropped; of contradicting ones the smaller counts.  Beyond
    ``max_rows`` rows, those of the smallest hashes of doc_id stay: a bounded sample that does
    not depend on partitioning.
    """
    kept = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("label"))
    )
    n = kept.count()
    if n > max_rows:
        kept = kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    return kept
