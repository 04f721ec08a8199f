"""Language identification by known words first, backing off to ever shorter character n-grams for unseen ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

FOLDS = 5
#: The fit reads about so many documents over all languages together, chosen by a hash of their ids.
SAMPLE_DOCS = 20_000
#: Known words, and known n-grams of each length, over all languages together.
VOCABULARY = 200_000
LENGTHS = (4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"
#: Words whose scores a task keeps at most, and the length of the longest that it keeps.
MEMO_WORDS, MEMO_LENGTH = 100_000, 40
#: A text is of a learned language if so many hundredths of its words are known or hold a known n-gram of 3 or more.
EVIDENCE = 20

_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, text_hash long, held_out boolean, lang_pred string, score double"


class Table:
    """Log frequencies of known values, one row each, in 32-bit numbers; values lie in one Arrow array, not in objects."""

    def __init__(self, values: pa.StringArray, rows: np.ndarray):
        self.values, self.rows = values, rows

    def find(self, wanted: list[str]) -> np.ndarray:
        """The rows' numbers; -1 for what is not known."""
        found = pc.fill_null(pc.index_in(pa.array(wanted, pa.string()), value_set=self.values), -1)
        return found.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Model:
    """Log frequencies by language (the columns): of known words, and of known n-grams by their length."""

    languages: list[str]
    words: Table
    grams: dict[int, Table]


def held_out():
    """The fold that never trains; a null id counts as empty text and is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def labelled_sample(docs: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text) of a sample of the labelled rows outside the held-out fold, an equal share for each language.

    A language with no more rows than its share gives all; of others each row is in if a hash of its id falls below
    the share, so that about ``limit`` rows come together whatever the size of the table.  No language is sorted.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select(
        "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("hash")
    )
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-rows")
    share = max(1, limit // max(1, counts.count()))
    # one row per language
    return rows.join(F.broadcast(counts), "lang").where(F.col("hash") * F.col("n") < F.lit(share << 30)).select("lang", "text")


def _known(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """(lang, value, n) in all languages of the values that are among the ``limit`` most frequent of any."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), column))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= limit).select(column).distinct()
    return counts.join(kept, column, "left_semi").select("lang", F.col(column).alias("value"), "n")


def _table(known: DataFrame, languages: list[str], totals: dict[str, int]) -> Table:
    found = known.toArrow()  # at most the vocabulary, once for each language that has the value
    values = found.column("value").cast(pa.string()).combine_chunks().dictionary_encode()
    place = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((len(values.dictionary), len(languages)))
    counts[values.indices.to_numpy(), [place[lang] for lang in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    total = np.array([totals.get(lang, 0) for lang in languages]) + SMOOTHING * (len(counts) + 1)
    return Table(values.dictionary, np.log((counts + SMOOTHING) / total).astype(np.float32))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY) -> Model:
    """Count words and n-grams of the sample with Spark; the most frequent ones make a model of bounded size."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    counts = (
        labelled_sample(docs, sample_docs)
        .select("lang", F.explode(found).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    counts = stored(counts, "language-words")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    languages = sorted(totals)
    share = max(1, vocabulary // max(1, len(languages)))
    words = _table(_known(counts, "word", share), languages, totals)
    grams = {}
    for length in LENGTHS:
        padded = F.concat(F.lit(" "), "word", F.lit(" ")) if length > 1 else F.col("word")
        starts = F.sequence(F.lit(1), F.length(padded) - (length - 1))
        parts = counts.withColumn("padded", padded).where(F.length("padded") >= length).select(
            "lang", "n", F.explode(F.transform(starts, lambda k: F.substring(F.col("padded"), k, F.lit(length)))).alias("gram")
        )
        parts = stored(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
        sums = {r.lang: r.n for r in parts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        grams[length] = _table(_known(parts, "gram", share), languages, sums)
    return Model(languages, words, grams)


class Scorer:
    """Scores of whole texts under a model."""

    def __init__(self, model: Model, memo_words: int = MEMO_WORDS):
        self.model, self.memo_words = model, memo_words
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, max(1, len(model.languages)) + 1), np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """One row per word: log frequencies by language, then 1 if the word is evidence.

        A known word has its own; any other the mean over its known n-grams of the greatest length that has any.
        """
        width = self.table.shape[1] - 1
        out = np.zeros((len(words), width + 1), np.float32)
        at = self.model.words.find(words)
        # a model that learned nothing has rows of no width
        if (at >= 0).any():
            out[at >= 0, :width] = self.model.words.rows[at[at >= 0]]
            out[at >= 0, width] = 1
        left = np.flatnonzero(at < 0)
        for length in LENGTHS:
            texts = [f" {words[k]} " if length > 1 else words[k] for k in left.tolist()]
            sizes = [max(0, len(text) - length + 1) for text in texts]
            at = self.model.grams[length].find([text[k : k + length] for text, n in zip(texts, sizes) for k in range(n)])
            owner = np.repeat(np.arange(len(left)), sizes)[at >= 0]
            n = np.bincount(owner, minlength=len(left))
            sums = np.zeros((len(left), width))
            if len(owner):
                np.add.at(sums, owner, self.model.grams[length].rows[at[at >= 0]])
            some = n > 0
            out[left[some], :width] = sums[some] / n[some, None]
            out[left[some], width] = length >= 3
            left = left[~some]
        return out

    def _places(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of ``self.table`` for the words of some texts; the table starts anew when it is full."""
        unseen = [w for w in set().union(*texts) if w not in self.places]
        if len(self.places) + len(unseen) > self.memo_words:
            self.places = {}
            self.table = self.table[:0]
            unseen = list(set().union(*texts))
        start = len(self.table)
        self.table = np.concatenate([self.table, self.score(unseen)])
        self.places.update(zip(unseen, range(start, start + len(unseen))))
        found = [np.fromiter(map(self.places.__getitem__, words), np.int64, len(words)) for words in texts]
        for word in unseen:
            if len(word) > MEMO_LENGTH:
                del self.places[word]
        return found

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, its share of the likelihood, share of the words that are evidence) for each text."""
        out = []
        for start in range(0, len(texts), 100):
            part = texts[start : start + 100]
            words = [_WORD.findall(text.lower()) if text else [] for text in part]
            for text, found, places in zip(part, words, self._places(words)):
                if not self.model.languages or not text or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, 0.0))
                    continue
                sums = self.table[places].sum(axis=0, dtype=np.float64)
                total = sums[:-1] / max(1, len(found)) ** 0.5
                odds = np.exp(total - total.max())
                best = int(total.argmax())
                out.append((self.model.languages[best], float(odds[best] / odds.sum()), float(sums[-1]) / max(1, len(found))))
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_hash, held_out, lang_pred, score), one row for each row of ``docs``; only the text is read.

    ``lang_pred`` is ``und`` with score 0 if the text is null, has no letter, or nothing was learned; else the most
    likely learned language (ties: the first by name) with its share of the likelihood.  Repeated rows are scored
    alike; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY and the lengths

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer(batch.column("text").to_pylist())
            columns = {c: batch.column(c) for c in ("doc_id", "text_hash", "held_out")}
            columns["lang_pred"] = pa.array([lang for lang, *_ in found], pa.string())
            columns["score"] = pa.array([share for _, share, _ in found], pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(whole_text()).alias("text_hash"),
        held_out().alias("held_out"),
        "text",
    )
    return rows.mapInArrow(score, SCHEMA)


def with_known_language(docs: DataFrame, model: Model, evidence: int = EVIDENCE) -> DataFrame:
    """The rows of ``docs`` whose text is of a learned language.

    Rejected are texts that are null, empty or without a letter, and those in which less than ``evidence`` hundredths
    of the words are known or hold a known n-gram of 3 or more characters.  If nothing was learned (no labels, an
    empty table), every text with a letter stays.  Rows are judged one by one, so repeated rows stay or go together;
    all columns are kept as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            if shared.value.languages:
                kept = [lang != UNKNOWN and 100 * known >= evidence for lang, _, known in scorer(texts)]
            else:
                kept = [bool(text) and any(map(str.isalpha, text)) for text in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    text_at = docs.columns.index("text")
    return docs.mapInArrow(keep, docs.schema)
