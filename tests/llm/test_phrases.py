"""Collocations, the index below them, and their counts against plain sums."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from logmill.llm import phrases

SCHEMA = "lang string, text string, doc_id long, n long, word string, key string"


def plain_phrases(rows, min_count, max_words, top=2000):
    counts = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, max_words + 1):
                counts.update((lang, *words[k : k + size]) for k in range(len(words) - size + 1))
    total = collections.Counter()
    for key, n in counts.items():
        total[key[0]] += n * (len(key) == 2)
    candidates = {key: n for key, n in counts.items() if len(key) > 2 and n >= min_count}
    covered = set()
    for (lang, *words), n in candidates.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                part = (lang, *words[k : k + size])
                if 100 * n >= 80 * candidates[part]:
                    covered.add(part)
    found = collections.defaultdict(list)
    for (lang, *words), a in candidates.items():
        if (lang, *words) in covered:
            continue
        cuts = [(counts[lang, *words[:k]], counts[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank + 1, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, rows in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top])
    )


def random_rows(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "B", "b", "ä", "Ä", "c1", "d\x85e", "éa"]
    ends = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", " : "]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60))) for _ in range(n)]
    texts += [None, "", " \n ", "...", "b b b b b b", texts[0], texts[0]]
    return [(rng.choice(["x", "y", None, "und"]), t) for t in texts]


@pytest.mark.parametrize("min_count, max_words, shard_words", [(3, 4, 100), (2, 2, 10**6), (4, 5, 1)])
def test_phrases_against_plain_counts(spark, min_count, max_words, shard_words):
    rows = random_rows(min_count)
    frame = spark.createDataFrame([(lang, t, 1, 2, "w", "k") for lang, t in rows], SCHEMA).repartition(3)
    found = phrases.mine_phrases(frame, min_count, max_words, shard_words=shard_words).collect()
    assert sorted(tuple(r)[:8] for r in found) == plain_phrases(rows, min_count, max_words)


def test_phrases_at_the_ends(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.mine_phrases(empty).count() == 0
    one = spark.createDataFrame([("x", "never often enough", 1, 2, "w", "k"), (None, None, None, None, None, None)], SCHEMA)
    assert phrases.mine_phrases(one).count() == 0
    few = phrases.mine_phrases(spark.createDataFrame([("x", "p q r s t u. " * 9, 1, 2, "w", "k")], SCHEMA), 3, 2, top=2).collect()
    assert [(r.rank, r.phrase) for r in sorted(few)] == [(1, "p q"), (2, "q r")]


def test_long_text_is_sliced_between_pieces():
    data = (b"some words here. and more " * 500).translate(phrases._FOLD)
    parts = list(phrases.slices(data, 100))
    assert b"".join(parts) == data and max(map(len, parts)) < 200
    assert all(p.endswith(b"\xff") for p in parts[:-1])
    assert list(phrases.slices(b"x" * 500, 100)) == [b"x" * 500]


@pytest.mark.parametrize("seed", range(4))
def test_intervals_are_counts_in_both_directions(seed):
    rng = np.random.default_rng(seed)
    seq = np.r_[rng.integers(0, 5, 300), 0]
    grams = lambda size: collections.Counter(
        t for t in zip(*(seq[k:].tolist() for k in range(size))) if 0 not in t
    )
    index = phrases.ShardIndex(seq, 4)
    for size, left in ((2, seed % 2 == 0), (3, seed < 2), (4, True)):
        index.extend(left, lambda columns: np.ones(len(columns[0]), bool))
        found = dict(zip(zip(*(c.tolist() for c in index.columns)), index.size.tolist()))
        assert found == grams(size)
        # both intervals hold the same phrase: what follows it is as frequent as it is, by either transform
        for side, low in ((index.forward, index.low), (index.backward, index.there)):
            assert all(side.places.size >= lo + n for lo, n in zip(low, index.size))


def test_columns_are_packed_in_planes():
    rng = np.random.default_rng(2)
    for columns in ([np.array([0, 1, 255, 256, 1 << 40])], [rng.integers(0, 9, 50), np.zeros(50, np.int64)], [np.zeros(0, np.int64)]):
        assert [c.tolist() for c in phrases.unpack(phrases.pack(*columns))] == [c.tolist() for c in columns]


def test_dealt_phrases_are_summed():
    rng = np.random.default_rng(4)
    total, dealt = collections.Counter(), collections.defaultdict(list)
    for _ in range(5):
        grams = np.unique(rng.integers(0, 1200, (400, 3)) // 100, axis=0)
        n = rng.integers(1, 4, len(grams))
        total.update(dict(zip(map(tuple, grams.tolist()), n.tolist())))
        for batch in phrases._dealt(list(grams.T), n, 3):
            for part, data in zip(*(c.to_pylist() for c in batch.columns)):
                dealt[part].append(data)
    found = {}
    for data in dealt.values():
        table = phrases._summed(pa.table({"grams": pa.array(data, pa.binary())}), ["a", "b", "c"], 4)
        rows = list(zip(*(c.to_pylist() for c in table.columns)))
        assert not set(found) & {r[:3] for r in rows}
        found |= {r[:3]: r[3] for r in rows}
    assert found == {g: n for g, n in total.items() if n >= 4}


def test_filter_lets_frequent_phrases_pass(spark):
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 5000, (3000, 2))
    frame = spark.createDataFrame(pairs.tolist(), "w1 long, w2 long")
    for most in (phrases.FILTER_BITS, 1 << 10):
        packed = phrases.gram_filter(frame, ["w1", "w2"], most)
        at = phrases.gram_bits([pairs[:, 0], pairs[:, 1]], 8 * len(packed)).astype(np.int64)
        assert np.unpackbits(packed, bitorder="little")[at].all()
        other = phrases.gram_bits([pairs[:, 0] + 10_000, pairs[:, 1]], 8 * len(packed)).astype(np.int64)
        assert np.unpackbits(packed, bitorder="little")[other].mean() < 0.15


def test_shards_meet_their_words_by_one_plan(spark, monkeypatch):
    """Lists of words are gathered where they meet their shard, and neither side is sent to all tasks while it is small."""
    plans, keep = {}, phrases.stored

    def recording(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(phrases, "stored", recording)
    frame = spark.createDataFrame([(k, "a b c d " * 9, "en") for k in range(5)], "doc_id long, text string, lang string")
    assert phrases.mine_phrases(frame, shard_words=20).count() > 0
    assert "phrase-known" not in plans
    assert "SortMergeJoin [shard" in plans["phrase-coded"] and plans["phrase-coded"].count("Exchange hashpartitioning(shard") == 2
