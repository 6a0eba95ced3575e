"""Joins by keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_by_count(rows: DataFrame, counts: DataFrame, by: str, total: int, size: str = "n", most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Inner joins of ``rows`` with ``counts``, one row for each ``by``: for heavy keys, and for all others.

    ``size`` says how many of the ``total`` rows have the key.  Keys of over one in ``most`` rows are
    heavy; there are fewer than ``most``, so they are broadcast.  ``rows`` is read twice: stage it.
    """
    heavy = F.col(size) > total // most
    tagged = rows.join(F.broadcast(counts.where(heavy)), by, "left")
    light = tagged.where(F.col(size).isNull()).select(rows.columns).join(counts.where(~heavy), by)
    return tagged.where(F.col(size).isNotNull()), light


def join_by_count(rows: DataFrame, counts: DataFrame, by: str, total: int, size: str = "n", most: int = 4096) -> DataFrame:
    heavy, light = split_by_count(rows, counts, by, total, size, most)
    return heavy.unionByName(light)
