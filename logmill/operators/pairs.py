"""Distance columns on pairs, and nearest neighbours by common features.

Neighbours are looked for block by block: references are dealt into blocks of bounded size, and so are the texts that
ask, so that no key holds all pairs.  Inside a block the places of each word (or character, or pair of characters) tell
how much any reference can have in common with a text, rare features first; only references whose bound can still win
are compared.  The best of all blocks are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import METRICS, common_length
from ..functions.text import words
from ..session import materialize
from .scale import lookup_join

#: References, and asking texts, of a block at most about; and the bytes of either.
REFERENCE_ROWS, ASKING_ROWS, BLOCK_BYTES = 2_000, 20_000, 8 << 20
#: Edit distances to references of so many words of 64 characters are taken of whole batches of texts, all pairs.
FEW_WORDS, BATCH_TEXTS, BATCH_CHARS = 256, 4_096, 512


def pair_distance(pairs: DataFrame, left: str, right: str, metric: str) -> DataFrame:
    """Add ``distance`` to a table of pairs; ``metric`` is one of the names in METRICS."""
    return pairs.withColumn("distance", METRICS[metric](F.col(left), F.col(right)))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, distance = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        x = same | less
        d = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(d | more)), more & d
        distance += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1 | 1) & full, down << 1 & full
        more, less = down | (full & ~(x | up)), up & x
    return distance


def edit_distances(texts: list[str], others: list[str]) -> np.ndarray:
    """Levenshtein distances, a row per text and a column per other: a character of all texts at a time.

    As :func:`edit_distance`, in the bits of 64-bit numbers; what moves up or down at the end of one is carried on.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    codes = np.frombuffer("".join([texts[k] for k in order]).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, codes = np.unique(codes, return_inverse=True)
    numbers = {chr(c): k for k, c in enumerate(alphabet.tolist())}
    longest = int(sizes.max(initial=0))
    letters = np.zeros((len(texts), longest), np.intp)
    letters[np.arange(longest) < sizes[order][:, None]] = codes
    letters = np.ascontiguousarray(letters.T)
    # the longest texts come first, so those with a character at some place are a prefix
    reached = np.searchsorted(-sizes[order], -np.arange(longest)).tolist()
    out = np.empty((len(texts), len(others)), np.int64)
    one = np.uint64(1)
    for column, other in enumerate(others):
        if not other:
            out[:, column] = sizes
            continue
        tops = [np.uint64(min(63, len(other) - 1 - start)) for start in range(0, len(other), 64)]
        same = np.zeros((len(tops), len(numbers)), np.uint64)
        for k, c in enumerate(other):
            if c in numbers:
                same[k // 64, numbers[c]] |= np.uint64(1 << k % 64)
        more, less = (np.full((len(tops), len(texts)), v, np.uint64) for v in ((1 << 64) - 1, 0))
        distance = np.full(len(texts), len(other), np.int64)
        for place, count in zip(letters, reached):
            up, down = one, np.uint64(0)
            for word, top in enumerate(tops):
                p, m, hit = more[word, :count], less[word, :count], same[word].take(place[:count])
                x = hit | m
                hit |= down
                d = (((hit & p) + p) ^ p) | hit
                rises, falls = m | ~(d | p), p & d
                moved, fallen = rises << one | up, falls << one | down
                up, down = rises >> top & one, falls >> top & one
                less[word, :count] = moved & x
                more[word, :count] = fallen | ~(x | moved)
            distance[:count] += up.astype(np.int64) - down.astype(np.int64)
        out[order, column] = distance
    return out


class References:
    """Texts of one block in order of preference, with the places of their features."""

    def __init__(self, metric: str, texts: list[str], split: list[list[str]]):
        self.metric, self.texts, self.split = metric, texts, split
        bags = [Counter(self.features(t, w)) for t, w in zip(texts, split)]
        self.sizes = np.array([self.size(t, w) for t, w in zip(texts, split)], np.int64)
        rows_of: dict[str, list[tuple[int, int]]] = {}
        for row, bag in enumerate(bags):
            for feature, n in bag.items():
                rows_of.setdefault(feature, []).append((row, n))
        self.places = {f: np.array(p, np.int64).T for f, p in rows_of.items()}
        self.few = metric == "levenshtein" and sum(len(t) // 64 + 1 for t in texts) <= FEW_WORDS

    def features(self, text: str, split: list[str]) -> list[str]:
        if self.metric in ("jaccard", "lcs"):
            return split
        return list(text) if self.metric == "cosine" else [text[k : k + 2] for k in range(len(text) - 1)]

    def size(self, text: str, split: list[str]) -> int:
        return len(split) if self.metric in ("jaccard", "lcs") else len(text)

    def bounds(self, common: np.ndarray, size: int) -> np.ndarray:
        """Least distance that a reference with so much in common can have (for words and characters: the distance)."""
        if self.metric == "jaccard":
            union = self.sizes + size - common
            return np.where(union == 0, 0.0, 1 - common / np.maximum(union, 1))
        if self.metric == "cosine":
            norm = np.sqrt((self.sizes * size).astype(np.float64))
            return np.where(norm == 0, 1.0, 1 - common / np.where(norm == 0, 1, norm))
        if self.metric == "lcs":
            total = self.sizes + size
            return np.where(total == 0, 0.0, 1 - 2 * common / np.maximum(total, 1))
        longer = np.maximum(self.sizes, size)
        # an edit changes two pairs of neighbours at most
        edits = np.maximum(np.abs(self.sizes - size), (np.maximum(longer - 1, 0) - common + 1) // 2)
        return edits / np.maximum(longer, 1)

    def distance(self, text: str, split: list[str], row: int) -> float:
        if self.metric == "lcs":
            total = len(split) + len(self.split[row])
            return 1 - 2 * common_length(split, self.split[row]) / total if total else 0.0
        longer = max(len(text), len(self.texts[row]))
        return edit_distance(text, self.texts[row]) / longer if longer else 0.0

    def common(self, features: list[str], needed: int) -> np.ndarray:
        """Features shared with each reference, or too few of them for those that cannot reach ``needed``.

        Rare features come first.  When fewer are left than needed, a reference without any before is out; if none is
        in by then, the frequent ones are not looked at.
        """
        shared = np.zeros(len(self.texts), np.int64)
        bag = [(len(self.places[f][0]), f, n) for f, n in Counter(features).items() if f in self.places]
        left = sum(n for _, _, n in bag)
        for _, feature, n in sorted(bag):
            if left < needed and not shared.any():
                break
            rows, counts = self.places[feature]
            shared[rows] += np.minimum(counts, n)
            left -= n
        return shared

    def nearest_of_all(self, texts: list[str], split: list, k: int, within: float) -> Iterator[tuple[int, float, int]]:
        """(place of the text, distance, row) of the ``k`` best of each text, best first."""
        for start in range(0, len(texts), BATCH_TEXTS):
            some = range(start, min(start + BATCH_TEXTS, len(texts)))
            short = [n for n in some if len(texts[n]) <= BATCH_CHARS] if self.few else []
            if short:
                longer = np.maximum(self.sizes, np.array([[len(texts[n])] for n in short]))
                distances = edit_distances([texts[n] for n in short], self.texts) / np.maximum(longer, 1)
                order = np.argsort(distances, axis=1, kind="stable")[:, :k]
                distances = np.take_along_axis(distances, order, axis=1)
                for n, near, rows in zip(short, distances.tolist(), order.tolist()):
                    yield from ((n, d, row) for d, row in zip(near, rows) if d <= within)
            done = set(short)
            for n in some:
                if n not in done:
                    yield from ((n, d, row) for d, row in self.nearest(texts[n], split[n], k, within))

    def nearest(self, text: str, split: list[str], k: int, within: float) -> list[tuple[float, int]]:
        """(distance, row) of the ``k`` best that are no farther than ``within``; ties go to the earlier row."""
        size = self.size(text, split)
        needed = 1 if within < 1 else 0
        if within < 1 and self.metric == "jaccard":
            needed = int(np.ceil((1 - within) * size - 1e-9))
        elif within < 1 and self.metric == "lcs" and len(self.sizes):
            needed = int(np.ceil((1 - within) * (size + int(self.sizes.min())) / 2 - 1e-9))
        elif self.metric == "levenshtein":
            needed = 0
        bounds = self.bounds(self.common(self.features(text, split), needed), size)
        if self.metric == "cosine":
            bounds[[row for row in np.flatnonzero(self.sizes == size) if self.texts[row] == text]] = 0.0
        order = np.argsort(bounds, kind="stable")
        if self.metric in ("jaccard", "cosine"):
            return [(float(bounds[row]), int(row)) for row in order[:k] if bounds[row] <= within]
        best: list[tuple[float, int]] = []
        for row in order.tolist():
            if bounds[row] > within or (len(best) == k and bounds[row] > best[-1][0]):
                break
            distance = self.distance(text, split, row)
            if distance <= within:
                best = sorted([*best, (distance, row)])[:k]
        return best


def nearest(
    left: DataFrame,
    right: DataFrame,
    metric: str,
    k: int,
    block: Sequence[str] = (),
    tie: str = "y",
    within: float = float("inf"),
    reference_rows: int = REFERENCE_ROWS,
    asking_rows: int = ASKING_ROWS,
) -> DataFrame:
    """(block, x, y, distance, rank): the ``k`` nearest right texts of each left text inside the same block.

    Both sides have the ``block`` columns and one text column each, named ``x`` and ``y``; texts count once, and nulls
    have no neighbours.  Ties go by the right column ``tie``.  Texts farther than ``within`` are no neighbours.
    """
    keys = [*block] or ["_all"]
    if not block:
        left, right = (df.withColumn("_all", F.lit(0)) for df in (left, right))
    # stored, since it is counted before it is dealt
    asking = materialize(left.select(*keys, "x").where(F.col("x").isNotNull()).distinct())
    known = right.where(F.col("y").isNotNull()).groupBy(*keys, "y").agg(F.min(tie).alias("_tie"))

    def parts(df: DataFrame, text: str, rows: int, name: str) -> DataFrame:
        by_bytes = F.sum(F.octet_length(text)) / F.lit(BLOCK_BYTES)
        return df.groupBy(*keys).agg(F.ceil(F.greatest(F.count("*") / F.lit(rows), by_bytes, F.lit(1))).cast("int").alias(name))

    def split(text: str) -> Column:
        return words(F.col(text)) if metric in ("jaccard", "lcs") else F.lit(None).cast("array<string>")

    # one row per block
    sizes = materialize(parts(asking, "x", asking_rows, "_parts").join(parts(known, "y", reference_rows, "_chunks"), keys))
    one_chunk = sizes.where("_chunks > 1").isEmpty()
    asking = lookup_join(asking, sizes, keys, "inner").select(
        *keys,
        "x",
        split("x").alias("x_words"),
        F.pmod(F.xxhash64("x"), F.col("_parts")).cast("int").alias("_part"),
        F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"),
    )
    # named apart, since both sides may come from one table
    known = lookup_join(known, sizes, keys, "inner").select(
        *(F.col(c).alias(f"_of_{c}") for c in keys),
        "y",
        "_tie",
        split("y").alias("y_words"),
        F.pmod(F.xxhash64("y"), F.col("_chunks")).cast("int").alias("_at_chunk"),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_at_part"),
    )
    named = (F.col(f"_of_{c}").alias(c) for c in keys)
    schema = known.select(*named, F.lit("").alias("x"), "y", "_tie", F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).schema

    def best(asked: pa.Table, offered: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and offered.num_rows:
            ties, texts = offered.column("_tie").to_pylist(), offered.column("y").to_pylist()
            order = sorted(range(len(texts)), key=lambda r: (ties[r].encode() if isinstance(ties[r], str) else ties[r], texts[r].encode()))
            y_words = offered.column("y_words").to_pylist()
            found = References(metric, [texts[r] for r in order], [y_words[r] for r in order])
            asking_words = asked.column("x_words").to_pylist()
            out = [(n, order[r], d) for n, d, r in found.nearest_of_all(asked.column("x").to_pylist(), asking_words, k, within)]
        rows, places = (np.array([r[c] for r in out], np.int64) for c in (0, 1))
        # a text's references stand together, best first
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        rank = np.arange(1, len(rows) + 1) - np.repeat(starts, np.diff(starts, append=len(rows)))
        columns = [asked.column(c).take(pa.array(rows)) for c in (*keys, "x")] + [offered.column(c).take(pa.array(places)) for c in ("y", "_tie")]
        columns += [pa.array([d for *_, d in out], pa.float64()), pa.array(rank, pa.int32())]
        return pa.table(columns, [*keys, "x", "y", "_tie", "distance", "rank"])

    offered = known.groupBy(*(f"_of_{c}" for c in keys), "_at_chunk", "_at_part")
    found = asking.groupBy(*keys, "_chunk", "_part").cogroup(offered).applyInArrow(best, schema)
    if not one_chunk:
        # else a text has met all its references in one place
        rank = F.row_number().over(Window.partitionBy(*keys, "x").orderBy("distance", "_tie", "y"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(*block, "x", "y", "distance", "rank")
