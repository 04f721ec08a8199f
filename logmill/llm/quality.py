"""Quality by hashed n-gram likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into a fixed number of buckets.  Two multinomials over the buckets, one of trusted
documents and one of the whole corpus, give each bucket a weight, the logarithm of their ratio.  A document's score is
the mean weight of its n-grams; the verdict is a fixed threshold on it.  Weights are whole millionths, so that sums are
exact and every run decides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import SPACES, attach, stored, whole_text, words

BUCKETS = 1 << 14
#: Documents whose mean log ratio lies below are not kept.
THRESHOLD = -0.2
UNIT = 1_000_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def buckets(hashes: Column, n: int = BUCKETS) -> Column:
    """Buckets of all words, then of all pairs of neighbours, from the hashes of the words."""
    pairs = F.transform(
        hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(n)).cast("int")
    )
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(n)).cast("int"))
    return F.when(F.size(hashes) < 2, one).otherwise(F.concat(one, F.slice(pairs, F.lit(1), F.size(hashes) - 1)))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def bucket_counts(docs: DataFrame, n: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts: at most one row per bucket and task is shuffled."""
    found = let(lambda h: buckets(h, n), word_hashes(whole_text()))
    return docs.select(F.explode(found).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_weights(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> list[int]:
    """The log ratio of each bucket in millionths: ``n`` numbers, however large the corpus.

    The target is smoothed with as many pseudo-counts as there are buckets, spread like the corpus: without
    trusted documents every weight is 0, and so is that of a bucket that the corpus does not fill.
    """
    raw = stored(bucket_counts(docs, n), "quality-raw")
    target = stored(bucket_counts(trusted, n), "quality-target")
    sums = raw.agg(F.sum("n")).first()[0] or 0, target.agg(F.sum("n")).first()[0] or 0
    share = F.col("r.n") / F.lit(float(max(1, sums[0])))
    smooth = (F.coalesce(F.col("t.n"), F.lit(0)) + share * n) / F.lit(float(sums[1] + n))
    both = raw.alias("r").join(target.alias("t"), "bucket", "left")
    weights = [0] * n
    for row in both.select("bucket", F.round(F.log(smooth / share) * UNIT).cast("int").alias("weight")).collect():
        weights[row.bucket] = row.weight
    return weights


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, the first occurrence included."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                s, lambda x, j: ((j > 0) & (F.get(s, j - 1).h == x.h)) | F.coalesce(F.get(s, j + 1).h == x.h, F.lit(False))
            )
            return F.sort_array(F.transform(again, lambda x: x.i))

        def total(at: Column) -> Column:
            own = F.transform(at, lambda i, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - i, F.lit(window))))
            return F.aggregate(own, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(lambda s: let(total, starts(s)), ordered)
        )

    every = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(window)))
    )
    return F.when(F.size(hashes) < window, F.lit(0)).otherwise(let(covered, every))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        lambda lines: F.size(lines) - F.size(F.array_distinct(lines)),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    )


def assess(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, n: int = BUCKETS) -> DataFrame:
    """Counts, base verdict, score and verdict of every row of ``docs``.

    ``trusted_ids`` holds the ids (column doc_id) of the trusted documents; null ids and ids without a document count
    for nothing, repeated ids once.  A null text has no words and fails the base rules; a text without n-grams scores 0.  Rows are
    judged one by one, so repeated rows come out alike.  Other columns are ignored; an empty table gives an empty result.
    """
    trusted = attach(docs.select("doc_id", "text"), stored(trusted_ids.select("doc_id").distinct(), "trusted"), ["doc_id"], "left_semi")
    weights = bucket_weights(docs, trusted, n)
    by_bucket = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded into one constant
    text = whole_text()
    plain = F.regexp_replace(text, SPACES, "")

    def in_words(hashes: Column) -> Column:
        def score(found: Column) -> Column:
            return F.aggregate(found, F.lit(0).cast("long"), lambda total, b: total + F.get(by_bucket, b))

        return F.struct(
            F.size(hashes).cast("long").alias("n_words"),
            repeated_words(hashes).cast("long").alias("n_repeat_words"),
            let(score, buckets(hashes, n)).alias("total"),
        )

    rows = docs.select(
        "doc_id",
        F.length(plain).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_lines(text).cast("long").alias("n_dup_lines"),
        let(in_words, word_hashes(text)).alias("w"),
    )
    grams = F.when(F.col("n_words") > 0, 2 * F.col("n_words") - 1).otherwise(F.lit(1))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", "word_chars", "n_symbols", "n_dup_lines", "w.*").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("total") >= F.lit(int(threshold * UNIT)) * grams)).alias("kept"),
        (F.col("total") / grams / UNIT).alias("score"),
    )
