"""Quality rules: a hashed n-gram log-likelihood ratio beside plain text statistics, in DataFrame functions only.

Unigrams and bigrams of words fall into ``2**bits`` buckets.  Two multinomials over the buckets are estimated: one
from trusted target texts, one from all texts.  A text's score is the mean of log(target / raw) over its n-grams, and
each text is kept or rejected by one fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WORD, words

BITS = 14
#: Added to each bucket's count in both multinomials.  A count of mean m lowers the mean of its logarithm by m / (2 (m + a)**2)
#: at most, 1 / (8 a) in the worst case: with a = 16 less than a sixth of the threshold, in a corpus of any size.
SMOOTHING = 16.0
#: Mean log ratio per n-gram below which a text is rejected.
THRESHOLD = -0.05
SYMBOLS = "#*$%&|<>"


def _tail(array: Column, start: int) -> Column:
    return F.slice(array, start, F.greatest(F.size(array) - start + 1, F.lit(0)))


def _drop_last(array: Column) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0)))


def hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_w`` (hashes of the words) and ``_b`` (hashes of neighbouring words) to ``docs``."""
    w, text = F.col("_w"), F.col(text_col).cast("string")
    return docs.withColumn("_w", F.transform(words(text), lambda x: F.xxhash64(x))).withColumn("_b", F.zip_with(_drop_last(w), _tail(w, 2), lambda a, b: F.xxhash64(a, b)))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base columns to the result of ``hashed``."""
    text, w, b = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col("_w"), F.col("_b")
    h, s, p = F.col("_h"), F.col("_s"), F.col("_p")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    # windows of three words; a text without equal ones (nearly all) is done at once
    windows = F.zip_with(_drop_last(b), _tail(w, 3), lambda x, y: F.xxhash64(x, y))
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == x["x"], F.lit(False)))
    # sorted starts of the repeated windows: each covers three words, or those up to the next start
    covered = F.aggregate(F.zip_with(p, _tail(p, 2), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))), F.lit(0).cast("long"), lambda n, x: n + x)
    n_words = F.size(w).cast("long")
    return (
        docs.withColumn("n_words", n_words)
        .withColumn("word_chars", (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_h", windows)
        .withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
        .withColumn("_p", F.array_sort(F.transform(again, lambda x: x["i"])))
        .withColumn("n_repeat_words", F.when(s.isNull(), F.lit(0).cast("long")).otherwise(covered))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_lines", "_h", "_s", "_p")
    )


def bucket_ratios(docs: DataFrame, trusted: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log of target probability over raw probability, for each of the 2**bits buckets.

    Equal pseudo-counts, with the raw counts brought to the target's size, leave buckets without evidence neutral: a text
    is rejected on evidence, not for want of it.  ``trusted`` holds the ids of the target texts; without any, every ratio is 0.
    Spark counts; only the 2**bits sums reach the driver.
    """
    marks = trusted.select(F.col(id_col).cast("long").alias("_id")).where(F.col("_id").isNotNull()).distinct().withColumn("_t", F.lit(1))
    few = marks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    marked = source.join(F.broadcast(marks) if few else marks, "_id", "left")
    low = F.lit((1 << bits) - 1)
    # the outer form, since the plain one would compute the array twice to skip empty ones
    grams = hashed(marked, "_text").select("_t", F.explode_outer(F.concat("_w", "_b")).alias("h")).where(F.col("h").isNotNull()).select("_t", F.col("h").bitwiseAND(low).cast("int").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_t").alias("target"))
    rows = counts.collect()
    raws, targets = sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
    ratios = [0.0] * (1 << bits)
    if targets:
        for r in rows:
            expected = r["raw"] * targets / raws + smoothing
            ratios[r["bucket"]] = math.log((r["target"] + smoothing) / expected)
    return ratios


def quality_rules(docs: DataFrame, trusted: DataFrame, bits: int = BITS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the base columns, ``score`` (mean log ratio per n-gram) and ``kept``.

    A null text counts as empty; an empty text scores 0 and fails the base rule.  Nulls in other columns do not
    matter, repeated rows are scored each, an empty table gives an empty result.  Columns of ``docs`` stay unless
    they bear the name of an added one, which replaces them.  The table of 2**bits ratios is gathered in the driver
    (its size is fixed by ``bits``) and becomes a constant of the plan.
    """
    values = bucket_ratios(docs, trusted, bits, id_col=id_col, text_col=text_col)
    table = F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    g, low = F.concat("_w", "_b"), F.lit((1 << bits) - 1)
    total = F.aggregate(g, F.lit(0.0), lambda x, h: x + F.get(table, h.bitwiseAND(low).cast("int")))
    n = F.size("_w") + F.size("_b")
    return (
        text_statistics(hashed(docs, text_col), text_col)
        .withColumn("score", F.when(n > 0, total / n).otherwise(0.0))
        # as a generated column: a filter on it must not be pushed below, where it would compute every array again
        .withColumn("kept", F.explode_outer(F.array(~F.col("base_failed") & (F.col("score") >= threshold))))
        .drop("_w", "_b")
    )
