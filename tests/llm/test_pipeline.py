"""The pipeline's stages, each against brute force on its own input."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_quality import brute_kept
from tests.llm.test_texts import base_brute
from wayfold.llm import quality_rules, textstats
from wayfold.llm.secrets import redact_text
from wayfold.llm.tables import table
from wayfold.plans.staging import shared_dir
from wayfold.plans.staging import stage as staged

SF = "/root/testdata/sf0.001"


def by_hand(spark, name, docs):
    """What a stage leaves of rows of (doc_id, text), as such rows, in plain Python."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    if name == "quality_rules":
        rules = quality_rules.fit(textstats.with_counts(docs.select("doc_id", "text")), table(spark, SF, "labels"))
        return [r for r in rows if brute_kept(r[1], rules)]
    if name == "near_dedup":
        wanted, left = {(r[0], r[2]) for r in groups(rows, 5) if r[3]}, []
        seen = set()
        for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            # Rows without words stay; of equal rows, and of a group without any id, one does.
            if not (text or "").split():
                left.append((doc, text))
            elif any(d == doc for d, _ in wanted) and (doc, text) not in seen:
                seen.add((doc, text))
                left.append((doc, text))
        return left
    if name == "decontamination":
        items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
        clean = {r[0] for r in hits(rows, items) if not r[5]}
        return [r for r in rows if r[0] in clean]
    if name == "secret_scan":
        return [(d, t if t is None else redact_text(t)) for d, t in rows]
    return rows


@pytest.mark.parametrize("odd", [False, True])
def test_stages_are_what_is_worked_out_by_hand(spark, odd):
    docs = table(spark, SF, "documents")
    if odd:
        more = [(-1, None), (-2, ""), (-3, " \n"), (-4, "one two three four five six seven eight nine ten eleven"), (-5, "word " * 30_000), (None, "no id but ten words are here to be read as text")]
        more += [(-6, "token = abc123XYZ and more words so that there are ten of them here")]
        docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in more], docs.schema))
        for name in ("row", "body", "label", "n_words", "__text", "root"):
            docs = docs.withColumn(name, F.lit("own"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        want = by_hand(spark, name, docs)
        docs = staged(stage(spark, docs, SF), name)
        if name == "sentencepiece":
            assert docs.count() == len(want) and not docs.where("not coalesce(lossless, true)").count()
            continue
        assert docs.columns == columns
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted(got, key=str) == sorted(want, key=str), name
        if name == "secret_scan":
            assert all(not base_brute(t) for _, t in got)
        if odd and name != "near_dedup":
            assert docs.where("row <> 'own' or body <> 'own' or n_words <> 'own'").count() == 0


def test_an_empty_table_passes_all_stages(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.count() == 0


def standing(spark, label=""):
    """Bytes of the application's tables in the shared folder."""
    folder = Path(shared_dir(spark).removeprefix("file://")) / "wayfold" / spark.sparkContext.applicationId
    return sum(f.stat().st_size for f in folder.glob(f"{label}*/*.parquet"))


def test_stages_leave_no_copy_of_the_texts(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(1_000)), "en", "s", 1) for i in range(600)]
    rows += [(600 + i, rows[i][1], "en", "s", 1) for i in range(60)]
    path = f"{tmp_path}/documents"
    spark.createDataFrame(rows, table(spark, SF, "documents").schema).write.parquet(path)
    whole = sum(f.stat().st_size for f in Path(path).glob("*.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = standing(spark)
        stage(spark, spark.read.parquet(path), SF).write.parquet(path := f"{tmp_path}/{name}")
        assert standing(spark) - before < 0.1 * whole, name
    assert spark.read.parquet(path).count() == 600


def test_a_run_keeps_its_result_alone(spark):
    before = {name: standing(spark, f"pipeline-{name}") for name, _ in corpus_pipeline.STAGES}
    out = corpus_pipeline.run(spark, SF)
    grown = {name: standing(spark, f"pipeline-{name}") - before[name] for name, _ in corpus_pipeline.STAGES}
    assert [name for name, b in grown.items() if b] == ["sentencepiece"] and out.count()
