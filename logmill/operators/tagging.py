"""Few-shot token tagging: a linear model learned with Spark ML, applied inside each row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import align_tags
from ..functions.binding import let
from ..functions.correct import correct_template_parse
from ..functions.patterns import WILDCARD
from ..functions.text import (
    fine_pieces,
    finer_tokens,
    is_valid_template,
    normalize_ws,
)
from ..session import materialize

#: A model has this many slots for each feature at least, so that every feature finds one of its two slots free.
SLOTS_PER_FEATURE = 8


@dataclass(frozen=True)
class TaggerModel:
    """Weights of exactly the features of the sample: a slot holds a feature's 64-bit hash and its weight.

    A feature stands in one of two slots; one that stands in neither was not in the sample and counts for nothing.
    """

    hashes: tuple[int, ...]
    weights: tuple[float, ...]
    intercept: float

    def weight_of(self, feature: Column) -> Column:
        hashes = F.split(F.lit(",".join(map(str, self.hashes))), ",").cast("array<bigint>")
        weights = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        n = len(self.hashes)
        one, two = (F.pmod(h, F.lit(n)).cast("int") for h in (feature, F.shiftright(feature, 32)))
        return (
            F.when(F.get(hashes, one) == feature, F.get(weights, one))
            .when(F.get(hashes, two) == feature, F.get(weights, two))
            .otherwise(F.lit(0.0))
        )


def place_features(weights: dict[int, float], intercept: float) -> TaggerModel:
    """Lay out the features by cuckoo hashing, in a table that doubles until all have a place."""
    size = 16
    while size < SLOTS_PER_FEATURE * len(weights):
        size *= 2
    while True:
        table: dict[int, int] = {}
        if all(_insert(table, feature, size) for feature in sorted(weights)):
            hashes = [table.get(slot, _free(slot, size)) for slot in range(size)]
            return TaggerModel(tuple(hashes), tuple(weights.get(h, 0.0) for h in hashes), intercept)
        size *= 2


def _slots(feature: int, size: int) -> tuple[int, int]:
    return feature % size, (feature >> 32) % size


def _free(slot: int, size: int) -> int:
    """A number that is looked up in neither place of this slot."""
    return (slot + 1) % size + (((slot + 1) % size) << 32)


def _insert(table: dict[int, int], feature: int, size: int) -> bool:
    slot = _slots(feature, size)[0]
    for _ in range(100):
        feature, table[slot] = table.get(slot), feature
        if feature is None:
            return True
        one, two = _slots(feature, size)
        slot = two if slot == one else one
    return False


def labelled_tokens(samples: DataFrame, log: str = "log", template: str = "template") -> DataFrame:
    """Add ``tokens`` with tags, cut as the tagger sees them; labels that do not match are dropped."""
    return (
        samples.withColumn("tokens", align_tags(F.col(log), F.col(template)))
        .where(F.col("tokens").isNotNull())
        .withColumn("tokens", finer_tokens(F.col("tokens")))
    )


def misaligned_count(samples: DataFrame, log: str = "log", template: str = "template") -> DataFrame:
    """How many labels do not match their log."""
    tags = align_tags(F.col(log), F.col(template))
    return samples.agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(tags.isNull()).alias("n_misaligned")
    )


def _shape(word: Column) -> Column:
    """Digit runs as ``0``, upper-case letters as ``A`` and lower-case ones as ``a``."""
    s = F.regexp_replace(word, r"\p{Nd}+", "0")
    s = F.regexp_replace(s, r"\p{Lu}+", "A")
    return F.regexp_replace(s, r"[\p{L}&&[^A]]+", "a")


def _per_token(
    tokens: Column, shapes: Column, body: Callable[[Column, list[Column]], Column]
) -> Column:
    """``body(token, features)`` for every token: hashes of its text, its shape and its neighbours."""
    edge = F.lit("|")

    def slots(t: Column, i: Column, texts: Column, shapes: Column) -> list[Column]:
        shape = F.element_at(shapes, i + 1)
        before = F.coalesce(F.get(texts, i - 1), edge)
        after = F.coalesce(F.get(texts, i + 1), edge)
        glued = F.when(t["space_before"], "_").otherwise("+")
        features = {
            "w": [t["token"]],
            "s": [shape],
            "p": [glued, before],
            "n": [after],
            "ps": [F.coalesce(F.get(shapes, i - 1), edge), shape],
            "ns": [shape, F.coalesce(F.get(shapes, i + 1), edge)],
            "pn": [before, after],
        }
        return [F.xxhash64(F.lit(k), *v) for k, v in features.items()]

    def with_texts(tk: Column, sh: Column) -> Column:
        return let(
            lambda tx: F.transform(tk, lambda t, i: body(t, slots(t, i, tx, sh))),
            F.transform(tk, lambda t: t["token"]),
        )

    return let(with_texts, tokens, shapes)


def token_features(tokens: Column) -> Column:
    """Feature hashes of every token."""
    shapes = F.transform(tokens, lambda t: _shape(t["token"]))
    return _per_token(tokens, shapes, lambda t, slots: F.array(*slots))


def fit_tagger(
    samples: DataFrame, log: str = "log", template: str = "template", reg: float = 0.001
) -> TaggerModel:
    """Learn which tokens are parameters from labelled lines.  The samples are few by design."""
    # The repartition lets adaptive execution pack a small sample into few tasks.
    tokens = materialize(
        labelled_tokens(samples, log, template)
        .select(
            F.explode(
                F.arrays_zip("tokens", token_features(F.col("tokens")).alias("slots"))
            ).alias("t")
        )
        .select(
            F.col("t.tokens.tag").cast("double").alias("label"),
            F.col("t.slots").cast("array<string>").alias("slots"),
        )
        .repartition("slots")
    )
    classes = tokens.agg(F.min("label"), F.max("label")).first()
    if classes[0] is None:
        raise ValueError("no labelled tokens to learn from")
    if classes[0] == classes[1]:
        return place_features({}, 1.0 if classes[0] else -1.0)
    slots = CountVectorizer(
        inputCol="slots", outputCol="features", binary=True, vocabSize=1 << 30
    ).fit(tokens)
    fitted = LogisticRegression(maxIter=40, regParam=reg, standardization=False).fit(
        slots.transform(tokens)
    )
    weights = zip(map(int, slots.vocabulary), fitted.coefficients.toArray().tolist())
    return place_features(dict(weights), float(fitted.intercept))


#: Lines that are scored together in a task.
_LINES_AT_ONCE = 500


#: Seed of ``xxhash64``; the hash of several texts is that of the last one, seeded with the hash of those before.
_SEED = 42


def _hash(*values: str, seed: int = _SEED) -> int:
    """``xxhash64`` of some texts, unsigned."""
    for value in values:
        seed = xxhash.xxh64_intdigest(value.encode(), seed)
    return seed


class _Scorer:
    """Scores of the tokens of some lines: each feature is hashed once per distinct value, the rest are array look-ups."""

    def __init__(self, model: TaggerModel):
        self.weights = {h & (1 << 64) - 1: w for h, w in zip(model.hashes, model.weights)}
        self.intercept = model.intercept

    def _weigh(self, names: list[bytes], *kind: str) -> np.ndarray:
        weights, seed, digest = self.weights, _hash(*kind), xxhash.xxh64_intdigest
        return np.array([weights.get(digest(name, seed), 0.0) for name in names])

    def _of_pairs(self, names: list[bytes], kind: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, at = np.unique(left * len(names) + right, return_inverse=True)
        weights, seed, digest = self.weights, _hash(kind), xxhash.xxh64_intdigest
        seeds = [digest(name, seed) for name in names]
        one, two = (pairs // len(names)).tolist(), (pairs % len(names)).tolist()
        return np.array([weights.get(digest(names[b], seeds[a]), 0.0) for a, b in zip(one, two)])[at]

    def _scored(self, lines: pa.ListArray, shapes: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Of all lines: pieces, their tokens, whether a space stands before, tags; sizes and ends of the lines."""
        pieces = lines.flatten()
        spaced = pc.starts_with(pieces, " ")
        tokens = pc.utf8_ltrim(pieces, characters=" ")
        sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        n = len(pieces)
        tags = np.zeros(n, np.int32)
        if n and self.weights and any(self.weights.values()):
            tags = self._tags(tokens, pc.utf8_ltrim(shapes.flatten(), characters=" "), spaced, sizes, ends)
        elif self.intercept > 0:
            tags[:] = 1
        return pieces, tokens, spaced, tags, sizes, ends

    @staticmethod
    def _lists(lines: pa.ListArray, ends: np.ndarray, values: pa.Array) -> pa.ListArray:
        """A value of each token as lists of the lines."""
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values, mask=lines.is_null() if lines.null_count else None)

    def __call__(self, lines: pa.ListArray, shapes: pa.ListArray) -> pa.ListArray:
        _, tokens, spaced, tags, _, ends = self._scored(lines, shapes)
        kind = pa.list_(pa.struct([("token", pa.string()), ("space_before", pa.bool_()), ("tag", pa.int32())]))
        values = pa.StructArray.from_arrays([tokens, spaced, pa.array(tags)], names=["token", "space_before", "tag"])
        return self._lists(lines, ends, values).cast(kind)

    def templates(self, lines: pa.ListArray, shapes: pa.ListArray) -> pa.StringArray:
        """What ``tags_to_template`` makes of the tagged tokens, none of which holds a wildcard."""
        pieces, _, spaced, tags, sizes, ends = self._scored(lines, shapes)
        wild = tags == 1
        follows = np.roll(wild, 1)
        follows[(ends - sizes)[sizes > 0]] = False
        glued = pc.if_else(pa.array(follows), "", WILDCARD)
        values = pc.if_else(pa.array(wild), pc.if_else(spaced, f" {WILDCARD}", glued), pieces)
        return pc.utf8_trim(pc.binary_join(self._lists(lines, ends, values), ""), characters=" ")

    def _tags(self, tokens: pa.Array, shapes: pa.Array, spaced: pa.Array, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        first = np.zeros(len(tokens), bool)
        last = np.zeros(len(tokens), bool)
        some = sizes > 0
        first[(ends - sizes)[some]] = True
        last[ends[some] - 1] = True

        def coded(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
            """Distinct values and the edge; the numbers of each token, the one before and the one after."""
            coded = column.dictionary_encode()
            names = [*coded.dictionary.cast(pa.binary()).to_pylist(), b"|"]
            own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            before, after = np.roll(own, 1), np.roll(own, -1)
            before[first] = after[last] = len(names) - 1
            return names, own, before, after

        names, own, before, after = coded(tokens)
        forms, shape, shape_before, shape_after = coded(shapes)
        glued = spaced.to_numpy(zero_copy_only=False)
        score = np.full(len(tokens), self.intercept)
        # added in the order of the features
        score += self._weigh(names, "w")[own]
        score += self._weigh(forms, "s")[shape]
        score += np.where(glued, self._weigh(names, "p", "_")[before], self._weigh(names, "p", "+")[before])
        score += self._weigh(names, "n")[after]
        score += self._of_pairs(forms, "ps", shape_before, shape)
        score += self._of_pairs(forms, "ns", shape, shape_after)
        score += self._of_pairs(names, "pn", before, after)
        return (score > 0).astype(np.int32)


def _scored_with(model: TaggerModel, column: str, kind: str, score: Callable[[_Scorer, pa.Array, pa.Array], pa.Array]) -> Column:
    """``score`` of some lines at a time.  The shape of a whole line, cut the same way, gives the shapes of its tokens."""

    def scored(lines: pa.Array, shapes: pa.Array) -> pa.Array:
        scorer = _Scorer(model)
        starts = range(0, max(len(lines), 1), _LINES_AT_ONCE)
        return pa.concat_arrays([score(scorer, lines.slice(k, _LINES_AT_ONCE), shapes.slice(k, _LINES_AT_ONCE)) for k in starts])

    line = normalize_ws(F.col(column))
    pieces = fine_pieces(line)
    # without weights no shape counts
    shapes = fine_pieces(_shape(line)) if any(model.weights) else F.lit(None).cast("array<string>")
    return F.arrow_udf(scored, kind)(pieces, shapes)


def tag_lines(df: DataFrame, model: TaggerModel, column: str = "Content") -> DataFrame:
    """Add ``tokens`` with predicted tags.  Whole lines are tagged; nothing is shuffled."""
    kind = "array<struct<token: string, space_before: boolean, tag: int>>"
    return df.withColumn("tokens", _scored_with(model, column, kind, _Scorer.__call__))


def induce_templates(df: DataFrame, model: TaggerModel, column: str = "Content") -> DataFrame:
    """Add the template a line suggests, and whether it is worth storing."""
    template = _scored_with(model, column, "string", _Scorer.templates)
    return df.withColumn("template", correct_template_parse(template)).withColumn("valid", is_valid_template(F.col("template")))


def parameter_vocabulary(train: DataFrame, validation: DataFrame, k: int) -> DataFrame:
    """The tokens most often found at parameter positions of ``validation`` among those of ``train``.

    Both inputs have a ``tokens`` column with tags.
    """

    def params(df: DataFrame) -> DataFrame:
        return df.select(F.explode("tokens").alias("t")).where("t.tag = 1").select("t.token")

    counts = params(validation).join(params(train).distinct(), "token", "left_semi")
    return (
        counts.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(k)
    )
