import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.llm.decontaminate import DecontaminationParams, decontaminate, drop_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for s in range(len(w)):
            for n in {len(x) for x in windows}:
                own = windows.get(tuple(w[s : s + n])) if s + n <= len(w) else None
                if own:
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "Élan", "naïve"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 9, 10, 11, 30])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "--- !"), (7, items[7][1]), (103, items[7][1]), (104, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    rows = []
    for i in range(120):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        if i % 3 == 0:
            w[3:3] = items[rnd.randrange(40)][1].split()
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    return rows + [(500, None), (501, ""), (502, "w1 " * 40), (3, rows[3][1]), (None, items[5][1])], items


def test_matches_brute_force(spark, docs):
    rows, items = fixture()
    table = spark.createDataFrame(items, "item_id long, text string")
    for p in (DecontaminationParams(), DecontaminationParams(max_bits=64)):
        got = decontaminate(docs(rows), table, p).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)


def test_clean_rows_stay_with_their_columns(spark, docs):
    rows, items = fixture()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = drop_contaminated(docs(rows), table)
    assert got.columns == docs(rows).columns
    clean = sorted((str(r[0]) for r in brute(rows, items) if not r[5]))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == clean


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate(docs([(1, "a b"), (2, None)]), none).collect()] == [False, False]
    assert decontaminate(docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_items_without_an_id_hit_and_count_as_one(spark, docs):
    rows = [(1, "a1 b1 c1 d1"), (2, "x a1 b1 y c1"), (3, "a1 c1 b1"), (4, "k1 l1")]
    table = spark.createDataFrame([(None, "a1 b1"), (None, "c1 d1"), (7, "b1 c1 d1"), (8, "k1 l1")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate(docs(rows), table).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (4, 2, sha("7"), True), 2: (2, 1, sha(""), True), 3: (0, 0, sha(""), False), 4: (2, 1, sha("8"), True)}
    assert [r["doc_id"] for r in drop_contaminated(docs(rows), table).collect()] == [3]


@pytest.mark.parametrize("bits", [1 << 22, 64])
def test_further_columns_of_any_name_stay_as_they_are(spark, docs, bits):
    rows, items = fixture()
    table = spark.createDataFrame(items, "item_id long, text string")
    own = docs(rows)
    for name in ("row_key", "body", "n_words", "window", "__w", "a.b"):
        own = own.withColumn(name, F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    got = drop_contaminated(own, table, DecontaminationParams(max_bits=bits))
    assert got.columns == own.columns
    clean = {str(r[0]) for r in brute(rows, items) if not r[5]}
    want = [tuple(r) for r in own.collect() if str(r["doc_id"]) in clean]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bits", [1 << 22, 64])
def test_very_long_texts_and_passages_of_many_rows_and_items(spark, docs, bits):
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(i, f"{passage} {i} tail") for i in range(30)] + [(100 + i, passage) for i in range(30)]
    rows = [(i, f"{i} lead {passage} out {i % 3}") for i in range(90)] + [(1000, "filler words " * 40_000 + passage + " filler" * 20_000), (1001, "filler words " * 50_000)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs(rows), table, DecontaminationParams(max_bits=bits)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)
