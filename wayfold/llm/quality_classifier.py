"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Document statistics are standardised and mapped to ``features`` random cosines, whose inner
products approximate a Gaussian kernel.  Each partition of the labelled rows sums its own
normal equations; the sums are added and solved on the driver.  A fold of the training rows
that the ridge has not seen fits the isotonic step from raw scores to probabilities.

Bounds: ``max_labelled`` rows are learned from, in ``partitions`` parts, so the driver adds
that many matrices of ``features`` squared and sorts a fold of that sample; every document is
scored, on statistics of its whole text.

Edge cases: null and empty texts have all-zero statistics and are scored like any other; with
no usable labels every score is 0.5, with a single class that class's; where either fold lacks
a class, as with a handful of labels, all labelled rows serve as both; an empty table gives no
rows; very long texts are read whole; repeated documents score alike; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import map_batches
from wayfold.llm.tables import held_out, training_labels
from wayfold.llm.textstats import ratios, with_counts
from wayfold.plans.staging import stage


@dataclass(frozen=True)
class RidgeParams:
    max_labelled: int = 200_000
    features: int = 128
    partitions: int = 16
    ridge: float = 1e-3
    seed: int = 1


def statistics() -> dict[str, Column]:
    """Inputs of the score, of a comparable size each."""
    out = {}
    for name, x in ratios().items():
        out[name] = F.log1p(x) if name in ("words", "word_length", "line_words") else F.sqrt(x)
    out["characters"] = F.log1p(F.col("n_chars_all").cast("double"))
    return out


class Cosines:
    """Random Fourier features of standardised rows."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, gamma: float, p: RidgeParams):
        rng = np.random.Generator(np.random.PCG64(p.seed))
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * gamma), (len(mean), p.features))
        self.b = rng.uniform(0, 2 * np.pi, p.features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([f, np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and non-decreasing values of the least-squares fit of y on x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += t
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _matrix(batch: dict, names: list[str]) -> np.ndarray:
    return np.column_stack([batch[n].to_numpy(zero_copy_only=False) for n in names]).astype(float)


@dataclass
class Model:
    cosines: Cosines
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score, with a thousandth of the raw one so that ties keep their order."""
        raw = self.cosines(x) @ self.weights
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1)


def learn(stats: DataFrame, labels: DataFrame, p: RidgeParams = RidgeParams()) -> Model | float:
    """A model, or the one score that fits labels of no or one class."""
    names = list(statistics())
    known = training_labels(labels, "quality", p.max_labelled)
    rows = stats.join(known, "doc_id").withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0)
    rows = stage(rows.select("label", "calibrate", *names).repartition(p.partitions), "ridge-rows")
    got = rows.agg(
        F.count("*").alias("n"), F.avg("label").alias("share"), F.count_distinct("calibrate", "label").alias("kinds"),
        *(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names),
    ).first()
    if not got["n"]:
        return 0.5
    if got["share"] in (0.0, 1.0):
        return got["share"]
    mean = np.array([got[f"m_{n}"] for n in names])
    scale = np.array([got[f"s_{n}"] or 1.0 for n in names])
    cosines = Cosines(mean, scale, 1 / len(names), p)
    folds = got["kinds"] == 4

    def sums():
        def work(batch):
            use = ~(batch["calibrate"].to_numpy(zero_copy_only=False) & folds)
            z = cosines(_matrix(batch, names))[use]
            y = batch["label"].to_numpy(zero_copy_only=False)[use]
            return {"a": [(z.T @ z).tobytes()], "b": [(z.T @ y).tobytes()]}

        return work

    def added(parts):
        a = b = None
        for batch in parts:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(x), np.frombuffer(y)
                a, b = (x.copy(), y.copy()) if a is None else (a + x, b + y)
        if a is not None:
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

    parts = map_batches(rows, sums, "a binary, b binary").mapInArrow(added, "a binary, b binary").collect()
    width = p.features + 1
    a = sum(np.frombuffer(r["a"]).reshape(width, width) for r in parts)
    b = sum(np.frombuffer(r["b"]) for r in parts)
    weights = np.linalg.solve(a + p.ridge * np.trace(a) / width * np.eye(width), b)
    fold = (rows.where("calibrate") if folds else rows).toPandas()
    raw = cosines(fold[names].to_numpy(float)) @ weights
    return Model(cosines, weights, *isotonic(raw, fold["label"].to_numpy(float)))


def quality_scores(docs: DataFrame, labels: DataFrame, params: RidgeParams = RidgeParams(), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for each row of ``docs``."""
    counts = with_counts(docs.select("doc_id", "text"))
    stats = stage(counts.select("doc_id", *(c.alias(n) for n, c in statistics().items())), "ridge-stats")
    model, names = learn(stats, labels, params), list(statistics())

    def make():
        def work(batch):
            x = _matrix(batch, names)
            return {"doc_id": batch["doc_id"], "score": np.full(len(x), model) if isinstance(model, float) else model.score(x)}

        return work

    scored = map_batches(stats, make, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
