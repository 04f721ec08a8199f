"""Distances between two texts, for pairs that a join has already made."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .binding import let
from .text import similarity_tokens, words


def _ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num.cast("double") / den)


def common_length(x: Sequence[str], y: Sequence[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of one number.

    A zero bit marks a place of ``y`` where the common length grows; an addition carries each run to its next match.
    """
    places: dict[str, int] = {}
    for k, word in enumerate(y):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(y)) - 1
    state = full
    for word in x:
        hit = places.get(word)
        if hit:
            moved = state & hit
            state = ((state + moved) | (state - moved)) & full
    return len(y) - state.bit_count()


@F.pandas_udf(DoubleType())
def _lcs_share(x: pd.Series, y: pd.Series) -> pd.Series:
    """Twice the common subsequence over both lengths; null if both are empty or one is null."""
    return pd.Series(
        [None if a is None or b is None or not len(a) + len(b) else 2 * common_length(a, b) / (len(a) + len(b)) for a, b in zip(x, y)],
        dtype="float64",
    )


def _share(x: Column, y: Column, empty: float) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.coalesce(_lcs_share(x, y), F.lit(empty)))


def lcs_similarity(x: Column, y: Column) -> Column:
    """Twice the common subsequence over both lengths, on arrays; 0 if both are empty."""
    return _share(x, y, 0.0)


def lcs_distance(x: Column, y: Column) -> Column:
    return 1 - _share(words(x), words(y), 1.0)


def lev_distance(x: Column, y: Column) -> Column:
    """Edit distance over the longer length."""
    return _ratio(F.levenshtein(x, y), F.greatest(F.length(x), F.length(y)), 0.0)


def bag_overlap(x: Column, y: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    def least_count(v: Column) -> Column:
        count = lambda arr: F.size(F.filter(arr, lambda e: e == v))
        return F.least(count(x), count(y))

    return F.aggregate(
        F.array_intersect(x, y), F.lit(0), lambda total, v: total + least_count(v)
    )


def _bags(x: Column, y: Column) -> tuple[Column, Column]:
    """Multiset overlap and total size of two arrays."""
    return let(bag_overlap, x, y), F.size(x) + F.size(y)


def cosine_distance(x: Column, y: Column) -> Column:
    """One minus the overlap of the character bags over the geometric mean of the lengths."""
    overlap = let(bag_overlap, F.split(x, ""), F.split(y, ""))
    norm = F.sqrt((F.length(x) * F.length(y)).cast("double"))
    return F.when(x == y, F.lit(0.0)).otherwise(1 - _ratio(overlap, norm, 0.0))


def jaccard_distance(x: Column, y: Column) -> Column:
    """One minus intersection over union of the word bags."""
    return let(
        lambda overlap, total: 1 - _ratio(overlap, total - overlap, 1.0),
        *_bags(words(x), words(y)),
    )


def template_similarity(x: Column, y: Column) -> Column:
    """Common distinct tokens over both list lengths less the common ones."""
    def share(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a, b))
        return _ratio(common, F.size(a) + F.size(b) - common, 1.0)

    return let(share, similarity_tokens(x), similarity_tokens(y))


METRICS = {
    "lcs": lcs_distance,
    "levenshtein": lev_distance,
    "cosine": cosine_distance,
    "jaccard": jaccard_distance,
}
