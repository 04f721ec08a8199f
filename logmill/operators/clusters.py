"""Vocabulary and two-level clusters of labelled lines.

Words are counted over all lines, and ranked where a line lies: nearly every line's most frequent words are among the
most frequent of all, a bounded table.  Only the others are joined with the whole vocabulary.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.patterns import VOCABULARY_STOP_WORDS
from ..functions.text import char_signature, clean, split_text
from ..session import materialize
from .scale import counted_join

#: The head of the vocabulary that reaches every task: words, their bytes together, and the bytes of one.
HEAD_WORDS, HEAD_BYTES, HEAD_WORD_BYTES = 50_000, 4 << 20, 1_000


def distinct_pairs(df: DataFrame) -> DataFrame:
    return df.select("log", "label").distinct()


def nonempty_clean(df: DataFrame) -> DataFrame:
    """Add the cleaned text and keep the lines that have a word left."""
    return df.withColumn("clean", clean(F.col("log"))).where(F.col("clean") != "")


def _in_vocabulary(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(*VOCABULARY_STOP_WORDS)


def _vocabulary_words(text: Column) -> Column:
    return F.filter(split_text(text), _in_vocabulary)


def vocabulary(df: DataFrame, column: str = "clean", weight: str | None = None) -> DataFrame:
    """How often each word of more than two characters occurs, stop words aside."""
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    return (
        df.select(F.explode(split_text(F.col(column))).alias("token"), n.alias("_n"))
        .where(_in_vocabulary(F.col("token")))
        .groupBy("token")
        .agg(F.sum("_n").alias("n"))
    )


def topk_tokens(
    df: DataFrame, k: int = 3, column: str = "clean", weight: str | None = None
) -> DataFrame:
    """The ``k`` globally most frequent distinct words of each distinct text, as a sorted array.

    Ties go to the smaller word.  Texts without vocabulary words get an empty array.
    """
    n = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    texts = materialize(df.groupBy(column).agg(F.sum(n).alias("_lines")))
    return _with_topk(texts, materialize(vocabulary(texts, column, "_lines")), k, column).select(column, "tokens")


def _head(counts: DataFrame) -> dict[str, int]:
    """The most frequent words, at most HEAD_WORDS and about HEAD_BYTES, with their ranks; ties go to the smaller word."""
    order = [F.desc("n"), F.col("token")]
    short = F.when(F.octet_length("token") <= HEAD_WORD_BYTES, F.col("token")).alias("short")
    found = counts.orderBy(*order).limit(HEAD_WORDS).select(short).toArrow().column("short").to_pylist()
    ranks, size = {}, 0
    for word in found:
        size += 0 if word is None else len(word.encode())
        if word is None or size > HEAD_BYTES:
            break
        ranks[word] = len(ranks)
    return ranks


def _head_tokens(ranks: dict[str, int], k: int):
    """A function of texts: the ``k`` most frequent words; null where a word that is not in the head may be one of them."""
    names, known = list(ranks), {**dict.fromkeys(VOCABULARY_STOP_WORDS, -1), **ranks}

    def tokens(text: str | None) -> list[str] | None:
        if text is None:
            return None
        words = set(text.split(" "))
        found = [ranks[w] for w in words if w in ranks]
        if len(found) < k and any(len(w) > 2 and w not in known for w in words):
            return None
        return sorted([names[r] for r in sorted(found)[:k]])

    @F.pandas_udf(ArrayType(StringType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([tokens(t) for t in texts], dtype=object)

    return of


def _with_topk(df: DataFrame, counts: DataFrame, k: int, column: str) -> DataFrame:
    """Add ``tokens``, the ``k`` words of each row's text that are the most frequent by the stored ``counts``.

    Most texts have that many words of the head of the vocabulary, and are decided where they lie.  Only the others
    meet the whole vocabulary, word by word.
    """
    marked = materialize(df.withColumn("tokens", _head_tokens(_head(counts), k)(F.col(column))))
    done = marked.where("tokens IS NOT NULL")
    others = marked.where("tokens IS NULL").drop("tokens")
    if others.isEmpty():
        return done
    # stored and numbered, so that the word rows carry a number instead of the whole text
    texts = materialize(others.groupBy(column).agg(F.count(F.lit(1)).alias("_rows_of"))).withColumn(
        "_id", F.monotonically_increasing_id()
    )
    placed = texts.select(
        "_id", F.explode(F.array_distinct(_vocabulary_words(F.col(column)))).alias("token")
    )
    ranked = (
        counted_join(placed, counts.withColumn("_rows", F.col("n")), "token", "_rows", salt_by=F.col("_id"))
        .groupBy("_id")
        # a list of one row's own words, not of a group of rows
        .agg(F.collect_list(F.struct((-F.col("n")).alias("n"), "token")).alias("_words"))
        .select(
            "_id",
            F.array_sort(
                F.transform(F.slice(F.array_sort("_words"), 1, k), lambda w: w["token"])
            ).alias("tokens"),
        )
    )
    keys = texts.join(ranked, "_id", "left").select(
        column, "_rows_of", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")
    )
    rows = [c for c in df.columns if c != column]
    joined = counted_join(others, materialize(keys), column, "_rows_of", salt_by=F.struct(*rows) if rows else F.col(column))
    return done.unionByName(joined.select(*done.columns))


def cluster_lines(df: DataFrame, k: int = 3) -> DataFrame:
    """Distinct labelled lines with a coarse key (frequent words) and a fine key (special characters)."""
    # stored, since the words are counted over the whole pool before any line gets its key
    pool = materialize(
        nonempty_clean(distinct_pairs(df)).withColumn("fine", char_signature(F.col("log")))
    )
    keyed = _with_topk(pool, materialize(vocabulary(pool, "clean")), k, "clean")
    return keyed.select("log", "label", F.array_join("tokens", " ").alias("coarse"), "fine")


def cluster_sizes(lines: DataFrame) -> DataFrame:
    """One row per fine cluster, with the sizes at both levels."""
    fine = lines.groupBy("coarse", "fine").agg(F.count(F.lit(1)).alias("fine_size"))
    return fine.withColumn("coarse_size", F.sum("fine_size").over(Window.partitionBy("coarse")))
