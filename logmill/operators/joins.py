"""Joins between logs, predictions, template sets and corrections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import is_abstract
from ..functions.patterns import WILDCARD
from ..functions.text import words
from ..session import materialize
from .scale import checked_join, is_small, lookup_join


def drop_null_truth(df: DataFrame, column: str = "EventTemplate") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def pair_truth_prediction(
    truth: DataFrame,
    prediction: DataFrame,
    key: str = "LineId",
    column: str = "EventTemplate",
    by: Sequence[str] = (),
) -> DataFrame:
    """Line up both sides; a missing prediction, row or text, counts as the empty template."""
    left = drop_null_truth(truth, column).select(*by, key, F.col(column).alias("gt"))
    right = prediction.select(*by, key, F.col(column).alias("pred"))
    return left.join(right, [*by, key], "left").withColumn("pred", F.coalesce("pred", F.lit("")))


def seen_rows(df: DataFrame, templates: DataFrame, column: str = "gt") -> DataFrame:
    """Rows whose template is in the one-column set ``templates``."""
    known = templates.select(F.col(templates.columns[0]).alias(column)).distinct()
    return lookup_join(df, known, [column], "left_semi")


def unseen_rows(df: DataFrame, templates: DataFrame, column: str = "gt") -> DataFrame:
    """Rows whose template is not in the one-column set ``templates``."""
    known = templates.select(F.col(templates.columns[0]).alias(column)).distinct()
    return lookup_join(df, known, [column], "left_anti")


def apply_corrections(log: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace EventId and EventTemplate by mapping (dataset, EventId, EventTemplate → new_id, new_template).

    The join is on what the mapping has besides its new values.  Rows without a mapping keep their values and are
    marked ``unmapped``.
    """
    keys = [c for c in mapping.columns if c not in ("new_id", "new_template")]
    new = mapping.select(*keys, F.col("new_id").alias("_id"), F.col("new_template").alias("_template"))
    return lookup_join(log, new, keys).select(
        *[c for c in log.columns if c not in ("EventId", "EventTemplate")],
        F.coalesce("_id", "EventId").alias("EventId"),
        F.coalesce("_template", "EventTemplate").alias("EventTemplate"),
        F.col("_id").isNull().alias("unmapped"),
    )


def _static_anchor(word_list: Column) -> Column:
    """Longest wildcard-free word with its position; wildcards never span words, so positions agree."""
    entries = F.transform(
        word_list,
        lambda w, i: F.struct(F.length(w).alias("len"), i.alias("pos"), w.alias("word")),
    )
    static = F.filter(entries, lambda e: ~F.contains(e["word"], F.lit(WILDCARD)))
    best = F.array_max(static)
    return F.struct(
        F.coalesce(best["pos"], F.lit(-1)).alias("pos"),
        F.coalesce(best["word"], F.lit("")).alias("word"),
    )


def abstraction_pairs(general: DataFrame, specific: DataFrame) -> DataFrame:
    """Pairs (x, y) where template x is more general than y; both inputs have one column of distinct texts.

    A wildcard here never crosses a blank, so both texts have the same number of words and agree in every
    wildcard-free word.  One such word of x, with its place, is the join key.
    """
    x, y = F.col(general.columns[0]), F.col(specific.columns[0])
    left = general.select(x.alias("x"), words(x).alias("_w")).select(
        "x", F.size("_w").alias("n_words"), _static_anchor(F.col("_w")).alias("_a")
    ).select("x", "n_words", F.col("_a.pos").alias("pos"), F.col("_a.word").alias("word"))
    left = materialize(left)
    # the words travel with a number, not with the text
    lines = materialize(specific.select(F.monotonically_increasing_id().alias("_id"), y.alias("y")))
    keyed = lines.select("_id", words(F.col("y")).alias("_w")).select(
        "_id",
        F.size("_w").alias("n_words"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("word"))),
                F.transform("_w", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))),
            )
        ).alias("_k"),
    ).select("_id", "n_words", F.col("_k.pos").alias("pos"), F.col("_k.word").alias("word"))
    tried = checked_join(
        keyed, left, ["n_words", "pos", "word"], salt_by=F.col("_id"), small=is_small(left)
    ).select("_id", "x")
    return lines.join(tried, "_id").where(is_abstract(F.col("x"), F.col("y"))).select("x", "y")


def memo_lookup(
    df: DataFrame, column: str, compute: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run ``compute`` on the distinct values of ``column`` and join its result back to all rows.

    ``compute`` keeps ``column`` as a key.  The copies of a hot value are pre-aggregated before the
    shuffle; the join back is a left join, whose hot keys adaptive execution splits.
    """
    results = compute(df.select(column).distinct())
    return df.join(results, column, "left")
