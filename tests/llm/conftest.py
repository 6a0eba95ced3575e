import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs, with a further column that clashes with inner names."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumn("node", F.lit("x")).withColumn("label", F.lit(1)).withColumn("row", F.lit("y"))
        return df

    return make
