"""Numbers of rows that hold whenever a table is read, and joins that few rows go through."""

import pytest
from pyspark.sql import functions as F

from wayfold.llm.arrow import map_batches
from wayfold.llm.rows import numbered, without
from wayfold.plans.staging import stage


def as_read(rows):
    return sorted((r["row"], r["body"]["id"], r["body"]["_metadata"]) for r in rows.collect())


def test_numbers_do_not_depend_on_how_files_are_split(spark, tmp_path):
    path = f"{tmp_path}/odd name é%20+#"
    spark.range(5_000).select("id", F.lit("own").alias("_metadata"), F.lit("file").alias("file"), F.lit(1).alias("row")).repartition(3).write.parquet(path)
    want = as_read(numbered(spark.read.parquet(path)))
    assert len({r[0] for r in want}) == len(want) == 5_000 and all(r[2] == "own" for r in want)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert as_read(numbered(spark.read.parquet(path))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


@pytest.mark.parametrize("how", ["twice", "made", "none"])
def test_rows_of_anything_else_have_numbers_of_their_own(spark, tmp_path, how):
    path = f"{tmp_path}/t"
    spark.range(300).repartition(3).write.parquet(path)
    made = {"twice": spark.read.parquet(path, path), "made": spark.range(300).union(spark.range(300)), "none": spark.range(0).select("id")}[how]
    got = [(r["row"], r["body"]["id"]) for r in numbered(made).collect()]
    want = [] if how == "none" else 2 * list(range(300))
    assert sorted(i for _, i in got) == sorted(want) and len({n for n, _ in got}) == len(got)


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_without_is_exact_however_full_the_bitmap_is(spark, bits):
    rows = numbered(spark.range(3_000))
    for test in ("false", "body.id % 7 = 0", "true"):
        gone = stage(rows.where(test).select("row"), "gone")
        left = sorted(r["id"] for r in without(rows, gone.union(gone), bits).select("body.*").collect())
        assert left == sorted(r["id"] for r in rows.where(f"not ({test})").select("body.*").collect())


def test_parts_of_a_batch_have_the_bytes_that_an_operator_asks_for(spark):
    texts = spark.range(0, 1_000, 1, 1).select("id", F.repeat(F.lit("x"), 1_000).alias("text"))

    def sizes():
        return lambda batch: {"id": batch["id"], "rows": [len(batch["id"])] * len(batch["id"])}

    got = map_batches(texts, sizes, "id long, rows long", 20_000).collect()
    assert sorted(r["id"] for r in got) == list(range(1_000)) and max(r["rows"] for r in got) < 20
