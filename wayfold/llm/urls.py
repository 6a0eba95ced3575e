"""URL filters: fixed rules by host and path, and boosted trees for what no rule decides.

Urls that a rule decides are the labelled ones.  Trees are grown on lexical features in numpy
on the driver, on a bounded sample of them (``max_labelled``), by second-order boosting of the
logistic loss over feature histograms.  The ensemble is emitted as Spark expressions, so
scoring runs in the JVM in one projection.

Statistics of suffixes and first path segments are counted over all rows, by folds of hosts: a
labelled url gets those of the other folds, so its own label and those of its host are never
among its features.  Suffixes and segments of very many urls are joined by broadcast.

The driver gets at most about ``max_labelled`` rows of features, and trees of a fixed size leave it.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged by
the trees; with labels of one class only, that class is the verdict; without any,
``allow``; an empty table gives no rows; very long urls are read whole; repeated urls are judged alike;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.skew import join_by_count
from wayfold.plans.staging import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule): a rule fits its host and all subdomains of it if the path starts with the rule's.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@dataclass(frozen=True)
class BoostParams:
    max_labelled: int = 100_000
    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    folds: int = 5
    ridge: float = 1.0
    min_rows: int = 5


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _lexical(url: str) -> dict[str, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    digits = F.regexp_count(u, F.lit("[0-9]")).cast("double")
    share = F.transform(F.array_distinct("__chars"), lambda c: F.size(F.filter("__chars", lambda x: x == c)) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda acc, q: acc - q * F.log2(q))
    count = lambda pattern: F.regexp_count(u, F.lit(pattern)).cast("double")
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length("host").cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "digit_share": digits / n,
        "entropy": entropy,
        "parameters": count("[?&][^=&#?]*="),
        "hyphens": count("-"),
        "fragment": count("#"),
        "secure": u.startswith("https").cast("double"),
        "first_segment_length": F.length(F.regexp_extract("path", "^/([^/]*)", 1)).cast("double"),
    }


FEATURES = ["length", "host_length", "labels", "path_length", "depth", "digit_share", "entropy", "parameters", "hyphens", "fragment",
            "secure", "first_segment_length", "suffix_blocked", "suffix_rows", "segment_blocked"]


@dataclass
class Tree:
    """Nodes as (feature, cut, left, right) or a value."""

    nodes: list

    def column(self, names: list[str], at: int = 0) -> Column:
        node = self.nodes[at]
        if not isinstance(node, tuple):
            return F.lit(float(node))
        f, cut, left, right = node
        return F.when(F.col(names[f]) <= cut, self.column(names, left)).otherwise(self.column(names, right))


def boost(x: np.ndarray, y: np.ndarray, p: BoostParams) -> tuple[float, list[Tree]]:
    """Start value (log-odds) and trees; x without missing values, y of 0 and 1."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    z, trees = np.full(len(y), start), []
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-z))
        g, h = prob - y, prob * (1 - prob)
        nodes: list = []

        def grow(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append(0.0)
            gs, hs = g[rows].sum(), h[rows].sum()
            best, choice = 1e-6, None
            if depth < p.depth and len(rows) >= 2 * p.min_rows:
                for f, cut in enumerate(cuts):
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cut) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cut) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(cut) + 1))[:-1]
                    gain = gl**2 / (hl + p.ridge) + (gs - gl) ** 2 / (hs - hl + p.ridge) - gs**2 / (hs + p.ridge)
                    gain[(nl < p.min_rows) | (len(rows) - nl < p.min_rows)] = -1
                    if len(gain) and gain.max() > best:
                        best, choice = gain.max(), (f, int(gain.argmax()))
            if choice is None:
                value = -p.rate * gs / (hs + p.ridge)
                nodes[me] = value
                z[rows] += value
            else:
                f, k = choice
                left = binned[rows, f] <= k
                nodes[me] = (f, float(cuts[f][k]), grow(rows[left], depth + 1), grow(rows[~left], depth + 1))
            return me

        grow(np.arange(len(y)), 0)
        trees.append(Tree(nodes))
    return start, trees


def featured(pages: DataFrame, p: BoostParams, rules: list[tuple[str, str]]) -> tuple[DataFrame, int, int]:
    """Each row of ``pages`` with its rule, what that decides, and FEATURES; how many are decided, and how many of them blocked."""
    host, path = host_and_path("url")
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of("host", "path", rules)
    rows = rows.withColumns({"rule": rule, "decided": verdict, "__chars": F.split(F.coalesce("url", F.lit("")), "")})
    rows = rows.withColumns(_lexical("url")).withColumns({
        "suffix": F.element_at(F.split("host", r"\."), -1), "segment": F.regexp_extract("path", "^/([^/]*)", 1),
        "fold": F.pmod(F.xxhash64("host", F.lit(23)), F.lit(p.folds)).cast("int"),
    })
    rows = stage(rows.drop("__chars", "url"), "urls-rows")
    block, known = (F.col("decided") == "block").cast("int"), F.col("decided").isNotNull().cast("int")
    overall = rows.agg(F.sum(known).alias("n"), F.sum(F.coalesce(block, F.lit(0))).alias("blocked")).first()
    n, blocked = overall["n"] or 0, overall["blocked"] or 0
    prior = blocked / n if n else 0.5

    total = rows.count()

    def with_rates(to: DataFrame, by: str) -> DataFrame:
        in_fold = [(F.col("fold") == k).cast("int") for k in range(p.folds)]
        sums = lambda x: F.array(*(F.sum(F.coalesce(x, F.lit(0)) * i) for i in in_fold))
        counts = stage(rows.groupBy(by).agg(sums(known).alias("k"), sums(block).alias("b"), F.count("*").alias("n")), "urls-counts")
        others = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v) - F.when(F.col("decided").isNull(), 0).otherwise(F.get(x, F.col("fold")))
        met = join_by_count(to, counts, by, total)
        rate = (others("b") + 5 * prior) / (others("k") + 5)
        return stage(met.withColumns({f"{by}_blocked": rate, f"{by}_rows": F.log1p(F.col("n").cast("double"))}).drop("k", "b", "n"), "urls-rates")

    return with_rates(with_rates(rows, "suffix"), "segment"), n, blocked


def url_filter(pages: DataFrame, params: BoostParams = BoostParams(), rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (null where a rule decides) for each row of ``pages``."""
    p = params
    full, n, blocked = featured(pages, p, rules)
    if n and 0 < blocked < n:
        labelled = full.where("decided is not null")
        if n > p.max_labelled:
            labelled = labelled.where(F.pmod(F.xxhash64("page_id", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * p.max_labelled / n))
        sample = labelled.select((F.col("decided") == "block").cast("int").alias("y"), *FEATURES).toPandas()
        start, trees = boost(sample[FEATURES].to_numpy(float), sample["y"].to_numpy(float), p)
        score = F.lit(start)
        for tree in trees:
            score = score + tree.column(FEATURES)
        score = 1 / (1 + F.exp(-score))
    else:
        score = F.lit(float(n > 0 and blocked == n))
    judged = full.withColumn("block_score", F.when(F.col("decided").isNull(), score))
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "block_score")
