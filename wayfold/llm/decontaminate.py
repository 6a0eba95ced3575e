"""Benchmark decontamination by a prefix-filtered set join, in Spark expressions alone.

An item's windows are runs of ``window`` words (all its words if it has fewer).  A window is
the set of its short word shingles; a text that contains the window contains all of them,
so by the prefix principle at full containment one of them is enough to look for: the one
that is rarest in the corpus, counted over all documents.

1.  Shingle hashes of the benchmark make a bitmap (two places each), held as a literal.  Each
    document filters its own shingles through it, so what leaves the row is little more than
    true matches; counts of those give the order by rarity.
2.  The rarest shingle of each window is its prefix; a window that lacks a shingle everywhere is
    dropped.  A second pass over the documents emits matches of prefixes with the words around.
3.  Joined with the prefixes, a match gives the only place where the window can start; places
    that would reach over either end of the document are dropped (positional and length
    bounds), and the words themselves are compared with the window's.
4.  Documents with the same windows share their list of items, which is gathered once for each set
    of windows, so neither a passage of very many documents nor one of very many items multiplies.

Neither pass shuffles texts.  A benchmark of so many shingles that a bitmap of ``max_bits`` would
let through much else is joined instead: documents are numbered in a table of the shared folder,
their shingles meet the prefixes in a join, and the rows that have candidates are joined with those
to compare the words.  The results are the same.

Edge cases: a null or empty text has no words and is clean; items without words have no
windows; equal items count each under their own item_id, rows with one item_id count once; items
without an item_id count as one, which the list of ids leaves out; empty tables of documents or
items give no rows or no hits; very long texts are read whole;
repeated documents are judged row by row; further columns are not read, and kept as they are by
``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.rows import Bits, numbered, without
from wayfold.llm.skew import join_by_count
from wayfold.plans.staging import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 10
    shingle: int = 3
    max_bits: int = 1 << 22


def words(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _shingled(df: DataFrame, source: str, upto: int) -> DataFrame:
    """Adds ``__s1`` .. ``__s<upto>``: hashes of the shingles of 1 .. upto words at each place.

    ``__s<k>`` has as many entries as there are words; the last k - 1 of them are no shingles.
    """
    df = df.withColumn("__s1", F.expr(f"transform({source}, x -> xxhash64(x))"))
    for k in range(2, upto + 1):
        df = df.withColumn(f"__s{k}", F.expr(f"zip_with(__s{k - 1}, slice(__s1, {k}, size(__s1)), (x, y) -> xxhash64(x, y))"))
    return df


def windows(items: DataFrame, p: DecontaminationParams) -> tuple[DataFrame, DataFrame]:
    """(window, length, k, shingle, offset) of each distinct window; (window, item_id)."""
    own = items.select("item_id", words("text").alias("w")).where("size(w) > 0")
    own = own.withColumn("length", F.least(F.size("w"), F.lit(p.window)))
    spread = own.select("item_id", "length", "w", F.explode(F.expr("sequence(1, size(w) - length + 1)")).alias("s"))
    spread = spread.select("item_id", "length", F.slice("w", F.col("s"), F.col("length")).alias("w")).withColumn("window", F.array_join("w", " "))
    of = spread.select("window", "item_id").distinct()
    each = _shingled(spread.select("window", "length", "w").dropDuplicates(["window"]), "w", p.shingle)
    each = each.withColumn("k", F.least("length", F.lit(p.shingle)))
    chosen = F.coalesce(*(F.when(F.col("k") == k, F.col(f"__s{k}")) for k in range(1, p.shingle + 1)))
    each = each.withColumn("all", chosen).select("window", "length", "k", F.posexplode(F.expr("slice(all, 1, length - k + 1)")).alias("offset", "shingle"))
    return stage(each, "decon-windows"), stage(of, "decon-items")


def _scanned(docs: DataFrame, ks: list[int], find) -> tuple[DataFrame, Column]:
    """``docs`` with __w, n_words and the shingles, and all that ``find(k)`` finds among those of k words."""
    out = docs.withColumn("__w", words("text")).withColumn("n_words", F.size("__w").cast("long"))
    return _shingled(out, "__w", max(ks, default=1)), F.concat(*map(find, ks))


def _prefixes(table: DataFrame, seen: DataFrame) -> DataFrame:
    """(window, length, shingle, offset) of the rarest shingle of each window that may occur; ``seen`` has the documents' shingles."""
    counts = seen.groupBy("shingle").agg(F.count("*").alias("times")).join(table.select("shingle").distinct(), "shingle")
    rarest = F.min(F.struct("times", "shingle", "offset")).alias("rarest")
    found = table.join(counts, "shingle").groupBy("window", "length").agg(rarest, F.count("*").alias("present"), F.first("k").alias("k"))
    # All shingles of a window occur somewhere, or the window occurs nowhere.
    return stage(found.where("present = length - k + 1").select("window", "length", "rarest.shingle", "rarest.offset"), "decon-prefixes")


def _placed(matches: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``matches`` (row, n_words, place, shingle, ...) with the windows that they may be a part of, and where those start."""
    met = matches.join(prefixes, "shingle").withColumn("start", F.col("place") - F.col("offset"))
    return met.where("start >= 0 and start + length <= n_words")


def _by_bitmap(docs: DataFrame, table: DataFrame, ks: list[int], p: DecontaminationParams) -> tuple[DataFrame, DataFrame]:
    test = Bits(table.select("shingle"), 64, p.max_bits)
    out, found = _scanned(docs, ks, lambda k: F.filter(F.expr(f"slice(__s{k}, 1, greatest(size(__s{k}) - {k - 1}, 0))"), test))
    prefixes = _prefixes(table, out.select(F.explode(found).alias("shingle")))
    test = Bits(prefixes.select("shingle"), 64, p.max_bits)
    around = p.window - 1

    def matches(k: int) -> Column:
        own = F.when(F.size(f"__s{k}") >= k, F.filter(F.expr(f"sequence(0, size(__s{k}) - {k})"), lambda i: test(F.get(F.col(f"__s{k}"), i))))
        return F.transform(F.coalesce(own, F.array().cast("array<int>")), match(k))

    def match(k: int):
        def of(i: Column) -> Column:
            first = F.greatest(i - around, F.lit(0))
            near = F.slice(F.col("__w"), first + 1, F.lit(2 * around + k))
            return F.struct(i.alias("place"), F.get(F.col(f"__s{k}"), i).alias("shingle"), first.alias("first"), near.alias("near"))

        return of

    out, found = _scanned(docs, ks, matches)
    scanned = stage(out.select(F.monotonically_increasing_id().alias("row"), *docs.drop("text").columns, "n_words", found.alias("matches")), "decon-scanned")
    placed = _placed(scanned.where("size(matches) > 0").select("row", "n_words", F.explode("matches").alias("m")).select("row", "n_words", "m.*"), prefixes)
    own = F.array_join(F.slice("near", F.col("start") - F.col("first") + 1, F.col("length")), " ")
    return scanned.drop("matches"), placed.where(own == F.col("window")).select("row", "start", "length", "window")


def _by_join(docs: DataFrame, table: DataFrame, ks: list[int], p: DecontaminationParams) -> tuple[DataFrame, DataFrame]:
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), "*"), "decon-rows")
    whole = lambda k: F.expr(f"transform(slice(__s{k}, 1, greatest(size(__s{k}) - {k - 1}, 0)), (x, i) -> struct(i as place, x as shingle))")
    out, found = _scanned(rows.select("row", "text"), ks, whole)
    each = out.select("row", "n_words", F.explode(found).alias("m")).select("row", "n_words", "m.*")
    prefixes = _prefixes(table, each.select("shingle"))
    may = _placed(each, prefixes).groupBy("row").agg(F.collect_set(F.struct("start", "length", "window")).alias("may"))
    worded = rows.select("row", "text").join(may, "row").select("row", words("text").alias("__w"), "may")
    true = F.filter("may", lambda m: F.array_join(F.slice(F.col("__w"), m["start"] + 1, m["length"]), " ") == m["window"])
    occurrences = worded.select("row", F.explode(true).alias("m")).select("row", "m.*")
    return rows.select(*rows.drop("text").columns, F.size(words("text")).cast("long").alias("n_words")), occurrences


def find_windows(docs: DataFrame, items: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs`` (text and whatever is to be kept), their occurrences and the items of windows.

    Rows come without the text but with ``row``, which numbers them, and n_words; occurrences are (row, start,
    length, window), each once, and the last table is (window, item_id).
    """
    table, of = windows(items, p)
    ks = sorted(r["k"] for r in table.select("k").distinct().collect())
    if not ks:
        rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), *docs.drop("text").columns, F.size(words("text")).cast("long").alias("n_words")), "decon-scanned")
        return rows, table.select(F.lit(0).alias("row"), F.lit(0).alias("start"), "length", "window").limit(0), of
    # With a bit in 16 set at most, one of 256 other shingles passes.
    by = _by_bitmap if 32 * table.select("shingle").distinct().count() <= p.max_bits else _by_join
    rows, occurrences = by(docs, table, ks, p)
    return rows, stage(occurrences, "decon-occurrences"), of


def decontaminate(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``."""
    rows, occurrences, of = find_windows(docs.select("doc_id", "text"), items, params)
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.length - 1)))))")
    hit = occurrences.groupBy("row").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.sort_array(F.collect_set(F.xxhash64("window"))).alias("windows")
    ).select("row", covered.cast("long").alias("n_hit"), "windows", F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256).alias("set"))
    hit = stage(hit, "decon-hit")
    # The items of each set of windows, once.
    sets = hit.groupBy("set").agg(F.count("*").alias("rows"), F.first("windows").alias("windows"))
    listed = (
        sets.select("set", "rows", F.explode("windows").alias("window")).join(of.select(F.xxhash64("window").alias("window"), "item_id"), "window")
        .groupBy("set").agg(
            F.first("rows").alias("rows"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"),
            F.max(F.col("item_id").isNull().cast("int")).alias("nameless"),
        )
        .select("set", "rows", (F.size("ids") + F.col("nameless")).cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("sha"))
    )
    of_row = join_by_count(hit.select("row", "n_hit", "set"), stage(listed, "decon-sets"), "set", hit.count(), "rows")
    out = rows.join(of_row, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The rows of ``docs`` without any window of an item, with all columns."""
    rows = numbered(docs)
    scanned, occurrences, _ = find_windows(rows.select(F.col("row").alias("of"), "body.text"), items, params)
    gone = stage(scanned.join(occurrences, "row", "left_semi").select(F.col("of").alias("row")), "decon-gone")
    return without(rows, gone).select("body.*")
