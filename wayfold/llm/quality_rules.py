"""Quality rules: a decision list learned by sequential covering.

Statistics of labelled documents are cut at quantiles.  Rules that reject are grown one
threshold at a time on two thirds of the labelled rows (FOIL gain), pruned back to the
prefix that does best on the remaining third, and kept if that third confirms them; what a
rule covers is then set aside and the next rule is grown.  The list is emitted as an ordered
Spark conditional.  Every count is a Spark aggregation over (measure, bin): the driver
sees at most ``len(measures) * (bins + 1)`` rows at a time, whatever the corpus.

Edge cases: a null or empty text has no words and so fails the base rule; without usable
labels, or without both classes among them, the list is empty and only the base rule
rejects; repeated documents are judged alike, row by row; further columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.rows import numbered, without
from wayfold.llm.tables import training_labels
from wayfold.llm.textstats import COUNTS, base_failed, ratios, with_counts
from wayfold.plans.staging import stage, unstage


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = ratios()[self.measure]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class RuleParams:
    """``max_labelled`` bounds the sample that is learned from; ``min_precision`` is what the
    pruning third has to confirm; the rest bounds the size of the list."""

    max_labelled: int = 1_000_000
    bins: int = 40
    max_rules: int = 8
    max_conditions: int = 4
    min_precision: float = 0.9
    min_covered: int = 5


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: the 1-based number of the rule that rejects, or 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), k).otherwise(out)
    return out


def learn(labelled: DataFrame, params: RuleParams = RuleParams()) -> list[Rule]:
    """Rules from rows with ``label`` (1 good, 0 bad), the counts of ``with_counts`` and doc_id."""
    measures = ratios()
    names = list(measures)
    rows = stage(labelled.select("doc_id", "label", *(c.alias(n) for n, c in measures.items())), "rules-measures")
    quantiles = [k / params.bins for k in range(1, params.bins)]
    got = rows.agg(
        *(F.percentile_approx(n, quantiles, 10_000).alias(n) for n in names),
        F.sum(F.col("label")).alias("__good"), F.count("*").alias("__all"),
    ).first()
    if not got["__all"] or got["__good"] in (0, got["__all"]):
        return []
    # Midway between neighbours: a document just beside a labelled one falls on its side.
    cuts = {n: _between(sorted(set(got[n]))) for n in names}
    binned = F.array(*(_bin(n, cuts[n]) for n in names))
    table = stage(
        rows.select("label", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("prune"), binned.alias("bins")),
        "rules-bins",
    )

    def covered(conditions: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, cut in conditions:
            b = F.col("bins")[f]
            out = out & (b > cut if above else b <= cut)
        return out

    rules: list[list[tuple[int, bool, int]]] = []
    while len(rules) < params.max_rules:
        left = table
        for r in rules:
            left = left.where(~covered(r))
        rule = _grow(left.where(~F.col("prune")), covered, [len(cuts[n]) for n in names], params)
        rule = _prune(left.where("prune"), covered, rule, params) if rule else None
        if not rule:
            break
        rules.append(rule)
    return [Rule(tuple(Condition(names[f], above, cuts[names[f]][cut]) for f, above, cut in r)) for r in rules]


def _between(values: list[float]) -> list[float]:
    """``bin > i`` is ``x > cuts[i]``."""
    return [(a + b) / 2 for a, b in zip(values, values[1:])] or list(values)


def _doubles(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")


def _bin(measure: str, cuts: list[float]) -> Column:
    """How many of the cuts lie below the measure."""
    return F.size(F.filter(_doubles(cuts), lambda t: t < F.col(measure)))


def _grow(rows: DataFrame, covered, n_cuts: list[int], params: RuleParams):
    """Adds the threshold of the largest FOIL gain until no good row is covered or none gains."""
    conditions: list[tuple[int, bool, int]] = []
    while len(conditions) < params.max_conditions:
        counts = (
            rows.where(covered(conditions))
            .select(F.posexplode("bins").alias("f", "bin"), "label")
            .groupBy("f", "bin")
            .agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good"))
            .collect()
        )
        total_bad = sum(r["bad"] for r in counts if r["f"] == 0)
        total_good = sum(r["good"] for r in counts if r["f"] == 0)
        if total_bad < params.min_covered or (conditions and total_good == 0):
            break
        before = math.log2(total_bad / (total_bad + total_good))
        best, gain = None, 1e-9
        for f, n in enumerate(n_cuts):
            bad, good = [0] * (n + 1), [0] * (n + 1)
            for r in counts:
                if r["f"] == f:
                    bad[r["bin"]] += r["bad"]
                    good[r["bin"]] += r["good"]
            low_bad = low_good = 0
            for cut in range(n):
                low_bad, low_good = low_bad + bad[cut], low_good + good[cut]
                for above, b, g in ((True, total_bad - low_bad, total_good - low_good), (False, low_bad, low_good)):
                    if b >= params.min_covered and (x := b * (math.log2(b / (b + g)) - before)) > gain:
                        best, gain = (f, above, cut), x
        if best is None:
            break
        conditions.append(best)
    return conditions


def _prune(rows: DataFrame, covered, rule, params: RuleParams):
    """The prefix with the best (bad - good) / (bad + good) on rows that grew nothing; None if it isn't precise."""
    sums = []
    for k in range(1, len(rule) + 1):
        for label in (0, 1):
            sums.append(F.sum(F.when(covered(rule[:k]) & (F.col("label") == label), 1).otherwise(0)).alias(f"n{k}_{label}"))
    got = rows.agg(*sums).first()
    best, value = None, -1.0
    for k in range(1, len(rule) + 1):
        bad, good = got[f"n{k}_0"] or 0, got[f"n{k}_1"] or 0
        if bad and bad / (bad + good) >= params.min_precision and (bad - good) / (bad + good) + 1e-3 * math.log(bad) > value:
            best, value = rule[:k], (bad - good) / (bad + good) + 1e-3 * math.log(bad)
    return best


def fit(stats: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> list[Rule]:
    """Rules from a table of counts (one row per document) and ``labels`` (doc_id, quality)."""
    known = training_labels(labels, "quality", params.max_labelled)
    return learn(stats.join(known, "doc_id"), params)


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` plus base_failed, rule (the number of the rule that rejects, else 0) and kept."""
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def quality_rules(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and rule for each row of ``docs``."""
    stats = stage(with_counts(docs.select("doc_id", "text")).drop("text"), "rules-counts")
    return judge(stats, fit(stats, labels, params)).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned list keep, with their own columns.

    One pass counts every text and writes the counts with the rows' numbers; the labelled rows'
    counts are learned from, all rows are judged by theirs, and the rows that fail are left out by number.
    """
    rows = numbered(docs)
    counted = stage(with_counts(rows.select("row", "body.doc_id", "body.text")).drop("text"), "rules-counts")
    gone = stage(judge(counted, fit(counted, labels, params)).where("not kept").select("row"), "rules-gone")
    unstage(counted)
    return without(rows, gone).select("body.*")
