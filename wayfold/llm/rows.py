"""Rows of a table by numbers that hold whenever it is read, so that no copy of its texts has to stand anywhere.

A bitmap of row numbers lets nearly all other rows pass by a join: what is shuffled is little more than
what the join is about, and where the bitmap is too full to tell, all rows go through the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.plans.staging import stage

#: Rows of a file that can be numbered.
_FILE_ROWS = 1 << 40


class Bits:
    """Tests a 64-bit hash against a bitmap of a table's column of such hashes, in two places."""

    def __init__(self, hashes: DataFrame, per_key: int, max_bits: int):
        (name,) = hashes.columns
        n = hashes.distinct().count()
        self.bits = 64
        while self.bits < min(per_key * n, max_bits):
            self.bits *= 2
        rows = (
            hashes.select(F.explode(F.array(*self._places(F.col(name)))).alias("place"))
            .select(F.floor(F.col("place") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
        )
        held = [0] * (self.bits // 64)
        for r in rows:
            held[r["at"]] = r["bits"]
        # Folded into one literal array when the query is optimized.
        self.literal = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")

    def _places(self, x: Column) -> tuple[Column, Column]:
        """``bits`` is a power of two, so its lower and higher bits are two independent numbers."""
        return x.bitwiseAND(F.lit(self.bits - 1)), F.shiftrightunsigned(x, 32).bitwiseAND(F.lit(self.bits - 1))

    def __call__(self, x: Column) -> Column:
        one, two = (F.getbit(F.get(self.literal, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1 for place in self._places(x))
        return one & two


def _is_one_scan(docs: DataFrame) -> bool:
    """True if ``docs`` is all of one Parquet path: then a file's name and a place in it name a row."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    # Of several paths, one may be listed twice, and its rows are read twice then.
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and plan.relation().location().rootPaths().size() == 1


def numbered(docs: DataFrame) -> DataFrame:
    """(row, body): all columns of each row in a struct, as they may have any name, and its number.

    A table that is read from Parquet files is numbered as it stands there, by file and place; anything else
    is written to the shared folder first, as it may come out otherwise when it is made again.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("body")
    if _is_one_scan(docs):
        scan, body = docs, whole
    else:
        scan, body = stage(docs.select(whole), "numbered"), F.col("body")
    at = scan.metadataColumn("_metadata")
    placed = scan.select(body, at["file_path"].alias("file"), at["row_index"].alias("at"))
    files = sorted(r["file"] for r in placed.select("file").distinct().collect())
    numbers = scan.sparkSession.createDataFrame(list(enumerate(files)), "number long, file string")
    known = F.coalesce("number", F.raise_error(F.concat(F.lit("a file that came later: "), "file")).cast("long"))
    return placed.join(F.broadcast(numbers), "file", "left").select((known * _FILE_ROWS + F.col("at")).alias("row"), "body")


def maybe(keys: DataFrame, max_bits: int = 1 << 23) -> Column:
    """False for most values of ``row`` that are not in ``keys``, and for none that is; ``keys`` is read twice: stage it."""
    return Bits(keys.select(F.xxhash64("row").alias("hash")), 16, max_bits)(F.xxhash64("row"))


def without(rows: DataFrame, gone: DataFrame, max_bits: int = 1 << 23) -> DataFrame:
    """``rows`` whose number is not in ``gone``, a staged table of ``row``."""
    may = maybe(gone, max_bits)
    return rows.where(~may).union(rows.where(may).join(gone, "row", "left_anti"))
