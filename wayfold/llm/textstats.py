"""Statistics of whole texts, all of them Spark expressions within one row.

Words are maximal runs of characters other than space and U+0009..U+000D.  Each statistic
of a null text equals that of the empty text.  Nothing is exploded or shuffled: repeated
windows are found by sorting a row's own window hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
WINDOW = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COUNTS = ["n_chars_all", "n_lines", "n_upper", "n_bangs", "n_distinct"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _count_of(text: str, pattern: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(pattern)).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus COUNTS and MORE_COUNTS (long).

    Helper columns are named ``__ts_*`` and do not remain.  Arrays used inside lambdas are
    columns of an earlier projection; each is referenced more than once, so the optimizer keeps
    that projection and no lambda recomputes them.
    """
    own = docs.columns
    t, w, lines, h, s, d, p = (f"__ts_{x}" for x in ("t", "w", "lines", "h", "s", "d", "p"))
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({
        w: words(F.col(t)),
        lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }).withColumn(h, F.expr(f"transform({w}, x -> xxhash64(x))"))
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": _count_of(t, SYMBOL),
        "n_chars_all": F.length(t).cast("long"),
        "n_upper": _count_of(t, "[A-Z]"),
        "n_bangs": (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("!")))).cast("long"),
        "n_distinct": F.size(F.array_distinct(h)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    # Hashes of the windows of 2, 4 and then WINDOW = 5 words, each from the ones before.
    p2, p4 = "__ts_2", "__ts_4"
    out = out.withColumn(p2, F.expr(f"zip_with({h}, slice({h}, 2, size({h})), (x, y) -> xxhash64(x, y))"))
    out = out.withColumn(p4, F.expr(f"zip_with({p2}, slice({p2}, 3, size({h})), (x, y) -> xxhash64(x, y))"))
    out = out.withColumn(h, F.expr(
        f"slice(zip_with({p4}, slice({h}, 5, size({h})), (x, y) -> xxhash64(x, y)), 1, greatest(size({h}) - 4, 0))"
    ))
    # Positions whose window hash occurs again, in a list sorted by hash and then by position.
    out = out.withColumn(s, F.expr(
        f"if(size(array_distinct({h})) = size({h}), array(), sort_array(transform({h}, (x, i) -> struct(x as h, i as i))))"
    )).withColumn(d, F.expr(
        f"transform(filter(transform({s}, (x, k) -> struct(x.i as i, (k > 0 and {s}[k - 1].h = x.h) or (k + 1 < size({s}) and {s}[k + 1].h = x.h) as again)), x -> x.again), x -> x.i)"
    ))
    out = out.withColumn(p, F.sort_array(d))
    out = out.withColumn("n_repeat_words", F.expr(
        f"aggregate(transform({p}, (v, k) -> if(k + 1 < size({p}), least({WINDOW}, {p}[k + 1] - v), {WINDOW})), 0L, (a, x) -> a + x)"
    ))
    return out.select(*own, *COUNTS, *MORE_COUNTS)


def ratios() -> dict[str, Column]:
    """Scale-free measures of the counts, by name; 0 where the denominator is 0."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_chars_all"),
        "bang_share": share("n_bangs", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }


def base_failed() -> Column:
    """The fixed rule: too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
