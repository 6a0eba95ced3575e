"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents teach what toxic is; the others are unlabelled text, of which
a share (the class prior) is toxic as well.  The risk estimator corrects for that share and
is kept from going negative (Kiryo et al., 2017): where the corrected risk of the negative
class falls below zero, the step goes the other way.

Features are presences: of words, and of their first four and five characters, which stand for
families of forms.  Those of the positives are counted over all documents outside the held-out
fold as well, and the most telling ones kept; a linear model over them is fitted in numpy on
the driver.

Samples and vocabulary have documented bounds (``ToxicityParams``); every document is scored
on its whole text.  Rows are chosen by hashes of doc_id, so a rerun learns the same.

Words are runs of letters and digits: text written without spaces (Chinese, Japanese) is one word
between two signs, so there only what stands alone or begins such a run can tell.

Edge cases: null and empty texts have no features and get the score of the bias alone; where no
confirmed positive is among the documents, or none has a telling word, every score is 0; an empty
table gives no rows; very long texts are read whole; repeated documents score alike; further columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import map_batches
from wayfold.llm.tables import held_out, training_labels

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityParams:
    """Bounds: documents learned from, candidate features, features kept; then the optimizer's settings."""

    max_labelled: int = 200_000
    max_positive: int = 5_000
    max_unlabelled: int = 20_000
    max_candidates: int = 50_000
    max_features: int = 4_096
    min_positive: int = 4
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    bias: float


def features_of(word: str) -> tuple[str, ...]:
    """A word and its prefixes; a prefix ends in ``*``, which no word has."""
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 4 else (word,)


class Extractor:
    """Indices of known features in a text; remembers words."""

    def __init__(self, known: dict[str, int], limit: int = 200_000):
        self.known, self.limit, self.memory = known, limit, {}

    def __call__(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for w in set(WORD.findall(text.lower())) if text else ():
            got = self.memory.get(w)
            if got is None:
                if len(self.memory) >= self.limit:
                    self.memory.clear()
                got = self.memory[w] = tuple(self.known[f] for f in features_of(w) if f in self.known)
            if got:
                found.update(got)
        return sorted(found)


def _counts(docs: DataFrame, only: dict[str, int] | None) -> DataFrame:
    """(feature, n): in how many documents each feature is; counted per batch before the shuffle."""

    def make():
        extract = Extractor(only) if only is not None else None
        names = sorted(only, key=only.get) if only is not None else None

        def work(batch):
            total: Counter = Counter()
            for text in batch["text"].to_pylist():
                if extract is not None:
                    total.update(extract(text))
                elif text:
                    total.update({f for w in set(WORD.findall(text.lower())) for f in features_of(w)})
            keys = list(total)
            return {"feature": keys if names is None else [names[k] for k in keys], "n": [total[k] for k in keys]}

        return work

    return map_batches(docs.select("text"), make, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _vectors(docs: DataFrame, known: dict[str, int]) -> list[list[int]]:
    def make():
        extract = Extractor(known)
        return lambda batch: {"x": [extract(t) for t in batch["text"].to_pylist()]}

    return [list(r["x"]) for r in map_batches(docs.select("text"), make, "x array<int>").collect()]


def _sample(docs: DataFrame, n_rows: int, most: int, salt: int) -> DataFrame:
    if n_rows <= most:
        return docs
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * most / n_rows))


class _Rows:
    """Sparse 0/1 rows, with products both ways."""

    def __init__(self, rows: list[list[int]]):
        self.n = len(rows)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.columns = np.array([c for r in rows for c in r], np.int64)
        self.row_of = np.repeat(np.arange(self.n), self.lengths)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row_of, weights=w[self.columns], minlength=self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, weights=g[self.row_of], minlength=width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk under the logistic loss, by Adam on all rows."""
    pos, unl = _Rows(positive), _Rows(unlabelled)
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, p.steps + 1):
        zp, zu = pos.times(theta[:-1]) + theta[-1], unl.times(theta[:-1]) + theta[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Gradients by margin: of the positives as positive, as negative, and of the unlabelled as negative.
        as_pos, as_neg, unl_neg = prior * (sp - 1) / pos.n, prior * sp / pos.n, su / max(unl.n, 1)
        if negative >= 0:
            gp, gu = as_pos - as_neg, unl_neg
        else:
            gp, gu = as_pos + as_neg, -unl_neg
        grad = np.append(pos.back(gp, width) + unl.back(gu, width), gp.sum() + gu.sum())
        grad[:-1] += p.decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def learn(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> Model | None:
    """A model from documents outside the held-out fold; None without a confirmed positive among them that tells something."""
    known = training_labels(labels, "toxic", p.max_labelled)
    sizes = known.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not sizes["toxic"]:
        return None
    prior = min(0.9, max(0.001, sizes["toxic"] / sizes["n"]))
    own = docs.select("doc_id", "text")
    # At most max_positive ids: the texts stay where they are.
    chosen = known.where("label = 1").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(p.max_positive).select("doc_id")
    positives = own.join(F.broadcast(chosen), "doc_id", "left_semi")
    n_pos = positives.select("doc_id").count()
    if not n_pos:
        return None
    pool = own.where(~held_out())
    n_pool = pool.select("doc_id").count()
    unlabelled = _sample(pool, n_pool, p.max_unlabelled, 5)
    candidates = {
        r["feature"]: r["n"]
        for r in _counts(positives, None).where(F.col("n") >= p.min_positive).orderBy(F.desc("n"), "feature").limit(p.max_candidates).collect()
    }
    if not candidates:
        candidates = {r["feature"]: r["n"] for r in _counts(positives, None).orderBy(F.desc("n"), "feature").limit(p.max_features).collect()}
    index = {f: i for i, f in enumerate(sorted(candidates))}
    background = {r["feature"]: r["n"] for r in _counts(pool, index).collect()}
    n_unl = max(1, n_pool)
    telling = {f: n / n_pos * np.log((n / n_pos) / ((background.get(f, 0) + 0.5) / n_unl)) for f, n in candidates.items()}
    best = sorted((f for f in telling if telling[f] > 0), key=lambda f: (-telling[f], f))[: p.max_features]
    if not best:
        return None
    features = {f: i for i, f in enumerate(best)}
    weights, bias = fit_nnpu(_vectors(positives, features), _vectors(unlabelled, features), len(features), prior, p)
    return Model(features, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for each row of ``docs``."""
    model = learn(docs, labels, params)

    def make():
        if model is None:
            return lambda batch: {"doc_id": batch["doc_id"], "score": [0.0] * len(batch["doc_id"])}
        extract = Extractor(model.features)

        def work(batch):
            z = np.array([model.bias + model.weights[extract(t)].sum() for t in batch["text"].to_pylist()])
            return {"doc_id": batch["doc_id"], "score": _sigmoid(z)}

        return work

    scored = map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
