import random
import re

from wayfold.llm.near_dedup import DedupParams, drop_near_duplicates, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingle_set(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a][1] & sets[b][1])
            if i and 100 * i >= 80 * len(sets[a][1] | sets[b][1]):
                group[find(a)] = find(b)
    out = []
    for x, (doc, s) in enumerate(sets):
        ids = [sets[y][0] for y in range(len(sets)) if s and find(y) == find(x) and sets[y][0] is not None]
        component = min(ids, default=None) if s else doc
        out.append((doc, len(s), component, component is None if doc is None or component is None else doc == component))
    return sorted(out, key=str)


def corpus(seed=1):
    """Families of edited copies (a chain, a star, exact ones), unrelated texts, and shared passages."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, n = [], 0

    def add(w):
        nonlocal n
        rows.append((n, " ".join(w)))
        n += 1

    passage = text(40)
    for _ in range(60):
        add(text(rnd.randint(3, 120)) + (passage if rnd.random() < 0.4 else []))
    for _ in range(6):
        base = text(150)
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randint(0, 14)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            add(w)
    chain = text(100)
    for _ in range(20):
        for _ in range(4):
            chain[rnd.randrange(100)] = rnd.choice(words)
        add(chain)
    for _ in range(30):
        add(passage)
    rnd.shuffle(rows)
    return rows


def as_rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_components_equal_brute_force(spark, docs):
    rows = corpus()
    for k in (2, 5):
        assert as_rows(near_duplicates(docs(rows), DedupParams(shingle=k))) == brute(rows, k)


def test_small_blocks_and_few_bands_lose_nothing_within_stars(spark, docs):
    rows = corpus(2)
    assert as_rows(near_duplicates(docs(rows), DedupParams(shingle=2, block_tokens=500))) == brute(rows, 2)


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "É x"), (7, "é x"), (8, "a b " * 30_000), (9, "a b " * 30_001),
            (None, "one"), (None, "lone words here"), (10, "r s t"), (10, "r s t"), (11, "u\u00a0v w")]
    assert as_rows(near_duplicates(docs(rows), DedupParams(shingle=2))) == brute(rows, 2)
    assert near_duplicates(docs([])).count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    rows = [(10, "a b c d e f"), (10, "a b c d e f"), (11, "a b c d e f"), (12, "g h i j k l"), (13, None), (None, "a b c d e f")]
    got = drop_near_duplicates(docs(rows))
    assert got.columns == docs(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(10, "a b c d e f"), (12, "g h i j k l"), (13, None)], key=str)
    none = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, "")]
    assert sorted((str(r["text"]) for r in drop_near_duplicates(docs(none)).collect())) == ["", "None", "a b c d e f"]


def test_hubs_with_many_leaves_are_dealt_out(spark, docs):
    rows = corpus(3)
    assert as_rows(near_duplicates(docs(rows), DedupParams(shingle=2, leaves=2))) == brute(rows, 2)


def test_rows_without_ids_meet_no_other_rows(spark, docs):
    rows = corpus(4)
    unnamed = [(None, t) for _, t in rows] + [(7, t) for _, t in rows[:40]]
    assert as_rows(near_duplicates(docs(unnamed))) == brute(unnamed, 5)
    many = [(None, f"{k} words that are not those of any other row {k} {k}") for k in range(5_000)]
    assert sorted(r["text"] for r in drop_near_duplicates(docs(many, extra=False)).collect()) == sorted(t for _, t in many)
