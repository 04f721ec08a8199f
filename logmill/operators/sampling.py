"""Small diverse samples of labelled lines.

Every draw is ordered by a seeded hash, so it is repeatable and independent of partitioning.  Ranks are
filtered to at most the sample size, which Spark applies before the shuffle: a cluster that holds a third
of all lines sends only its best few from each task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import words
from ..session import materialize
from .clusters import cluster_lines, cluster_sizes
from .pairs import nearest


def shuffled(seed: int, *columns: str) -> Column:
    """A pseudo-random order that other engines can reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def _draw_order(seed: int, per_shot: bool) -> list[Column]:
    key = ["shot", "log", "label"] if per_shot else ["log", "label"]
    return [shuffled(seed, *key), F.col("log"), F.col("label")]


def _ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, top) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= top)


def stratified_sample(
    df: DataFrame,
    shots: Sequence[int],
    seed: int = 0,
    quota: str = "round_robin",
    independent: bool = False,
) -> DataFrame:
    """For each shot size a sample spread over coarse and fine clusters: shot, log, label.

    ``round_robin`` takes one line of every coarse cluster in turn, inside it one of every fine cluster in
    turn; smaller samples are then prefixes of larger ones, unless ``independent`` draws each anew.
    ``reference`` hands out equal shares in passes, as :func:`allocate` does.
    """
    # stored, since both the lines and the cluster sizes are read from it
    pool = materialize(cluster_lines(df))
    if quota == "reference":
        return _quota_sample(pool, shots, seed)
    if quota != "round_robin":
        raise ValueError(f"unknown quota mode {quota!r}")
    return round_robin_sample(pool, shots, seed, independent)


def round_robin_sample(
    lines: DataFrame, shots: Sequence[int], seed: int = 0, independent: bool = False
) -> DataFrame:
    """The round-robin draw on clustered lines (log, label, coarse, fine)."""
    top = max(shots)
    sizes = lines.groupBy("coarse", "fine").agg(F.count(F.lit(1)).alias("_size"))
    by = []
    if independent:
        lines = lines.withColumn("shot", F.explode(F.array(*map(F.lit, shots))))
        by = ["shot"]
    picks = _ranked(lines, [*by, "coarse", "fine"], _draw_order(seed, independent), "_r1", top)
    picks = picks.join(sizes, ["coarse", "fine"])
    picks = _ranked(
        picks, [*by, "coarse"], [F.col("_r1"), F.desc("_size"), F.col("fine")], "_r2", top
    )
    order = [F.col("_r2"), shuffled(seed, *by, "coarse"), F.col("coarse")]
    if independent:
        return _ranked(picks, by, order, "_r3", F.col("shot")).select("shot", "log", "label")
    # at most max(shots) rows are left to number
    first = picks.orderBy(*order).limit(top)
    placed = first.withColumn("_r3", F.row_number().over(Window.orderBy(*order)))
    return placed.withColumn("shot", F.explode(F.array(*map(F.lit, shots)))).where(
        F.col("_r3") <= F.col("shot")
    ).select("shot", "log", "label")


def allocate(sizes: Sequence[int], k: int) -> list[int]:
    """Share ``k`` places over clusters in passes: equal shares, at least one, at most the free room."""
    sizes = np.asarray(sizes, dtype=np.int64)
    quotas = np.zeros_like(sizes)
    left = min(int(k), int(sizes.sum()))
    while left > 0:
        share = left // len(sizes) + (np.arange(len(sizes)) < left % len(sizes))
        wish = np.minimum(np.maximum(share, 1), sizes - quotas)
        granted = np.clip(left - (np.cumsum(wish) - wish), 0, wish)
        quotas += granted
        left -= int(granted.sum())
    return quotas.tolist()


def _allocate_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("place")
    return group.assign(quota=allocate(group["size"], group["k"].iloc[0]))


def _quotas(clusters: DataFrame, by: Sequence[str]) -> DataFrame:
    """Quotas inside each group of ``clusters`` (columns size, place, k).

    The first pass gives every visited cluster a place, so only the first ``k`` clusters of a group can
    get any: a group in one task holds at most ``k`` rows.
    """
    first = clusters.where(F.col("place") <= F.col("k"))
    schema = StructType([*first.schema.fields, StructField("quota", LongType())])
    return first.groupBy(*by).applyInPandas(_allocate_group, schema)


def coarse_quotas(sizes: DataFrame, shots: Sequence[int], order: Sequence[Column]) -> DataFrame:
    """Places per coarse cluster and shot; ``sizes`` comes from :func:`cluster_sizes`."""
    top = max(shots)
    coarse = sizes.select("coarse", F.col("coarse_size").alias("size")).distinct()
    # at most max(shots) clusters are left to number
    coarse = coarse.orderBy(*order).limit(top)
    coarse = coarse.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    per_shot = coarse.withColumn("shot", F.explode(F.array(*map(F.lit, shots)))).withColumn(
        "k", F.col("shot")
    )
    return _quotas(per_shot, ["shot"]).select("shot", "coarse", "quota")


def fine_quotas(sizes: DataFrame, quotas: DataFrame) -> DataFrame:
    """Places per fine cluster, larger clusters first."""
    fine = sizes.join(quotas.where("quota > 0"), "coarse").select(
        "shot", "coarse", "fine", F.col("fine_size").alias("size"), F.col("quota").alias("k")
    )
    window = Window.partitionBy("shot", "coarse").orderBy(F.desc("size"), "fine")
    placed = fine.withColumn("place", F.row_number().over(window))
    return _quotas(placed, ["shot", "coarse"]).select("shot", "coarse", "fine", "quota")


def _quota_sample(lines: DataFrame, shots: Sequence[int], seed: int) -> DataFrame:
    sizes = cluster_sizes(lines)
    order = [shuffled(seed, "coarse"), F.col("coarse")]
    quotas = fine_quotas(sizes, coarse_quotas(sizes, shots, order))
    # at most one row per drawn line: sum(shots) rows
    pool = lines.join(F.broadcast(quotas.where("quota > 0")), ["coarse", "fine"])
    window = Window.partitionBy("shot", "coarse", "fine").orderBy(*_draw_order(seed, True))
    drawn = pool.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= max(shots))
    return drawn.where(F.col("_r") <= F.col("quota")).select("shot", "log", "label")


def _greedy(group: pd.DataFrame, n_candidate: int) -> Iterator[int]:
    """Positions of the picks: row 0, then in each round the candidate farthest from all picks.

    Overlaps with a new pick are found through the rows that share its words.
    """
    bags = [Counter(text.split()) for text in group["log"]]
    totals = np.array([sum(b.values()) for b in bags])
    lengths = group["log"].str.len().to_numpy()
    rounds = group["round"].to_numpy()
    rows_of: dict[str, list[tuple[int, int]]] = {}
    for row, bag in enumerate(bags):
        for word, n in bag.items():
            rows_of.setdefault(word, []).append((row, n))
    postings = {w: np.array(p) for w, p in rows_of.items()}
    nearest = np.full(len(group), np.inf)
    free = np.ones(len(group), dtype=bool)
    pick, k = 0, int(group["k"].iloc[0])
    for step in range(1, k + 1):
        yield pick
        free[pick] = False
        overlap = np.zeros(len(group))
        for word, n in bags[pick].items():
            rows = postings[word]
            overlap[rows[:, 0]] += np.minimum(rows[:, 1], n)
        union = totals + totals[pick] - overlap
        distance = 1 - np.divide(overlap, union, out=np.ones_like(overlap), where=union > 0)
        nearest = np.minimum(nearest, distance)
        if step == k or not free.any():
            return
        drawn = np.flatnonzero(free & (rounds == step))
        if len(drawn) < n_candidate:
            spare = np.flatnonzero(free & (rounds != step))
            drawn = np.concatenate([drawn, spare[: n_candidate - len(drawn)]])
        best = np.lexsort((drawn, -lengths[drawn], -nearest[drawn]))[0]
        pick = int(drawn[best])


def _greedy_sample(
    pool: DataFrame, by: Sequence[str], n_candidate: int, seed: int
) -> DataFrame:
    """Greedy picks per group of ``pool`` (log, label, k).

    Each line belongs to one random round, and a round keeps its first ``n_candidate`` lines by hash; a
    group in one task holds at most ``k * n_candidate + 1`` rows, and a hot group is spread over its rounds
    before that.
    """
    size = F.struct(F.size(words(F.col("log"))).alias("n"), F.length("log").alias("l"), "log", "label")
    starts = pool.groupBy(*by).agg(
        F.max_by(F.struct("log", "label"), size).alias("_s"), F.max("k").alias("k")
    ).select(*by, "_s.log", "_s.label", "k", F.lit(0).cast("bigint").alias("round"))
    n_rounds = F.greatest(F.col("k") - 1, F.lit(1)).cast("bigint")
    rounds = pool.select(
        *by, "log", "label", F.col("k").cast("int").alias("k"),
        (F.pmod(F.conv(F.substring(shuffled(seed, "label", "log"), 1, 8), 16, 10).cast("bigint"), n_rounds) + 1).alias("round"),
    )
    drawn = _ranked(rounds, [*by, "round"], _draw_order(seed, False), "_r", n_candidate).drop("_r")
    keys = [*by, "log", "label"]
    rest = drawn.join(starts.select(*keys), keys, "left_anti")
    candidates = starts.withColumn("k", F.col("k").cast("int")).unionByName(rest).withColumn(
        "_order", shuffled(seed, "log", "label")
    )

    def picks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["round", "_order"]).reset_index(drop=True)
        order = list(_greedy(group, n_candidate))
        chosen = group.loc[order, keys]
        return chosen.assign(pick=np.arange(1, len(order) + 1))

    schema = StructType(
        [*candidates.select(*keys).schema.fields, StructField("pick", LongType())]
    )
    group = list(by) or ["_all"]
    return candidates.withColumn("_all", F.lit(0)).groupBy(*group).applyInPandas(picks, schema)


def adaptive_sample(
    df: DataFrame, shots: Sequence[int], n_candidate: int = 128, seed: int = 0, by: Sequence[str] = ()
) -> DataFrame:
    """Start with the line of most words; then always take the candidate least like the picks so far.

    Smaller samples are prefixes of larger ones.  ``by`` names columns, such as the dataset, to sample apart.
    """
    pool = df.select(*by, "log", "label").distinct().withColumn("k", F.lit(max(shots)))
    picks = _greedy_sample(pool, by, n_candidate, seed)
    return picks.withColumn("shot", F.explode(F.array(*map(F.lit, shots)))).where(
        F.col("pick") <= F.col("shot")
    )


def cluster_adaptive_sample(
    df: DataFrame, shot: int, n_candidate: int = 8, seed: int = 0
) -> DataFrame:
    """Share ``shot`` over coarse clusters, larger first, and sample each one adaptively."""
    lines = materialize(cluster_lines(df))
    sizes = cluster_sizes(lines)
    quotas = coarse_quotas(sizes, [shot], [F.desc("size"), F.col("coarse")])
    # at most ``shot`` clusters have a quota
    wanted = F.broadcast(quotas.where("quota > 0").select("coarse", F.col("quota").alias("k")))
    pool = lines.join(wanted, "coarse").select("coarse", "log", "label", "k")
    return _greedy_sample(pool, ["coarse"], n_candidate, seed)


def min_distance(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Smallest word-bag distance of each distinct candidate text to the reference texts; 1e10 if there are none.

    Both inputs have one text column.
    """
    text = candidates.select(F.col(candidates.columns[0]).alias("x")).where("x IS NOT NULL").distinct()
    known = references.select(F.col(references.columns[0]).alias("y"))
    near = nearest(text, known, "jaccard", 1)
    return text.join(near, "x", "left").select(F.col("x").alias("candidate"), F.coalesce("distance", F.lit(1e10)).alias("distance"))
