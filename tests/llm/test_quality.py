import random
import re
import zlib

import numpy as np

from wayfold.llm import quality_classifier, quality_rules, textstats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    again = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def corpus(n, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeghilmnorst") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120))]
        good = rnd.random() < 0.7
        if not good:
            words = [w + "#$" if rnd.random() < 0.7 else w for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


EDGES = [
    (None, "a b c d e f g h i j k"), (1, None), (2, ""), (3, " \n\t "), (4, "word " * 30), (5, "a\u00a0b c\u2003d"), (6, "x|y\nx|y\n\nz"),
    (7, "p q r s t u p q r s t"), (8, "p q r s t p q r s t p"), (8, "p q r s t p q r s t p"), (9, "lang " * 20_000), (10, "é" * 50_000),
]


def test_counts_match_brute_force(spark, docs):
    rows = EDGES + corpus(60)[0]
    got = textstats.with_counts(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in textstats.COUNTS) == brute(r["text"]), r["doc_id"]


def test_rules_are_learned_and_good_documents_stay(spark, docs):
    rows, labels = corpus(900)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(rows), known).collect()}
    truth = {i: q for i, q, _ in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 200
    assert sum(got[i]["kept"] == bool(truth[i]) for i in held) >= 0.97 * len(held)
    kept = quality_rules.keep_good(docs(rows), known)
    assert kept.columns == docs(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}


def brute_ratios(text):
    """The measures that rules are about, counted in Python."""
    text = text or ""
    words = WORD.findall(text)
    n, chars, symbols, dup_lines, repeated = brute(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    share = lambda a, b: a / b if b else 0.0
    return {
        "words": float(n), "word_length": share(chars, n), "symbol_share": share(symbols, n), "dup_line_share": share(dup_lines, len(lines)),
        "repeat_share": share(repeated, n), "upper_share": share(len(re.findall("[A-Z]", text)), len(text)), "bang_share": share(text.count("!"), n),
        "distinct_share": share(len(set(words)), n), "line_words": share(n, len(lines)),
    }


def brute_kept(text, rules):
    n, *_, repeated = brute(text)
    if n < 10 or 100 * repeated > 20 * n:
        return False
    x = brute_ratios(text)
    return not any(all((x[c.measure] > c.threshold) == c.above for c in rule.conditions) for rule in rules)


def test_verdicts_follow_the_list(spark, docs):
    rows, labels = corpus(700, seed=8)
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(EDGES)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(textstats.with_counts(docs(rows, extra=False)), known)
    assert rules
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs(rows), known).collect()}
    assert got == {i: brute_kept(t, rules) for i, t in rows}
    assert {r["doc_id"] for r in quality_rules.keep_good(docs(rows), known).collect()} == {i for i in got if got[i]}


def test_classifier_scores_follow_the_model(spark, docs):
    rows, labels = corpus(300, seed=9)
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(EDGES)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats = textstats.with_counts(docs(rows, extra=False)).select("doc_id", *(c.alias(n) for n, c in quality_classifier.statistics().items()))
    model = quality_classifier.learn(stats, known)

    def inputs(text):
        x = brute_ratios(text)
        return [np.log1p(v) if k in ("words", "word_length", "line_words") else np.sqrt(v) for k, v in x.items()] + [np.log1p(len(text or ""))]

    got = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(docs(rows), known).collect()}
    want = dict(zip((i for i, _ in rows), model.score(np.array([inputs(t) for _, t in rows]))))
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_classifier_with_a_handful_of_labels(spark, docs):
    rows, _ = corpus(60, seed=11)
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    for k in range(0, 12, 2):
        known = spark.createDataFrame([(train[k], 0, 0), (train[k + 1], 1, 0)], "doc_id long, quality int, toxic int")
        got = quality_classifier.quality_scores(docs(rows), known).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.quality_scores(docs([]), known).count() == 0


def test_rules_on_edges_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs(EDGES), none).collect()
    assert len(got) == len(EDGES)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert all(r["base_failed"] for r in got if r["n_words"] < 10)
    assert quality_rules.quality_rules(docs([]), none).count() == 0


def test_classifier_holds_out_and_generalises(spark, docs):
    rows, labels = corpus(900, seed=5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs(rows + [(5000, None), (5001, "")]), known).collect()
    truth = {i: q for i, q, _ in labels}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_classifier_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs([(1, "a b"), (2, None)]), none).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]


def test_isotonic_is_monotone_least_squares():
    knots, values = quality_classifier.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert values.tolist() == [0.0, 0.5, 1.0] and knots.tolist() == [1.0, 2.5, 4.0]
