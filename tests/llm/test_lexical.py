"""Ranked search against plain scores, and the walk against all pairs."""

import collections
import math
import random
import re

import numpy as np
import pytest

from logmill.llm import lexical

DOCS = "doc_id long, text string, item_id long, score long, number int, _nr long"
ITEMS = "item_id long, text string, doc_id long, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=20):
    counted = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    all_docs, all_terms = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, tf, _ in counted for t in tf)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, tf, n in counted:
            m = 75 + 25 * n * all_docs // all_terms
            score = 0
            for term in terms(text):
                if term in tf:
                    w = math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * tf[term] // (1000 * tf[term] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda r: (r[0], r[1], r[2] or 0))[:top])]
    return sorted(out, key=str)


def texts(seed, n, length):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)] + ["É", "é", "ÄB", "x\x85y", "a-b", "日本", "İ"]
    out = [rng.choice([" ", ", ", "/"]).join(rng.choice(words) for _ in range(rng.randrange(1, length))) for _ in range(n)]
    return out + [None, "", " .,- ", out[0], out[0], out[1]]


@pytest.mark.parametrize("limit, limit_bytes", [(2000, 1 << 20), (7, 1 << 20), (2000, 60)])
def test_search_against_plain_scores(spark, limit, limit_bytes):
    docs = list(enumerate(texts(1, 300, 40))) + [(None, "w1 w2 É"), (5, "w1 w2"), (5, "w1 w2")]
    items = list(enumerate(texts(2, 20, 12))) + [(None, "w1 é"), (3, "w2 w2 w3")]
    frame = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 8, 9) for i, t in items], ITEMS)
    found = lexical.search_documents(frame, asked, limit=limit, limit_bytes=limit_bytes).collect()
    assert sorted(map(tuple, found), key=str) == plain_search(docs, items)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 4)], DOCS)
    items = spark.createDataFrame([(1, "a", 1, 1)], ITEMS)
    nothing = [spark.createDataFrame([], s) for s in (DOCS, ITEMS)]
    assert lexical.search_documents(nothing[0], items).count() == 0
    assert lexical.search_documents(docs, nothing[1]).count() == 0
    blank = spark.createDataFrame([(1, " ", 1, 1), (2, None, 1, 1)], ITEMS)
    assert lexical.search_documents(docs, blank).columns == lexical.search_documents(docs, items).columns
    assert lexical.search_documents(docs, blank).count() == 0


@pytest.mark.parametrize("kind", [np.float64, np.int64])
@pytest.mark.parametrize("count, width", [(1, 1), (9, 3), (500, 40), (5000, 60)])
def test_walk_keeps_what_all_pairs_give(kind, count, width):
    rng = np.random.default_rng(count)
    # rows of a group have terms of their own, so that whole nodes can be pruned
    group = np.arange(width) // 6
    own = lambda n: (rng.integers(0, width // 6 + 1, (n, 1)) == group) & (rng.random((n, width)) < 0.6)
    docs = rng.integers(0, 900_000, (count, width)) * own(count)
    docs[:, 0] += 5
    items = rng.integers(0, 9000, (37, width)) * own(37)
    ids = rng.permutation(count).tolist()
    best = lexical.Best(len(items), 5)
    tree = lexical.Tree.over(items.astype(kind), lexical.LEAF_ITEMS)
    scored = pairs = 0
    for start in range(0, count, 700):
        part = slice(start, start + 700)
        a, b = lexical.search(items.astype(kind), tree, docs[part].astype(kind), ids[part], best)
        scored, pairs = scored + a, pairs + b
    scores = items @ docs.T
    for k, found in enumerate(best.found):
        expected = sorted((-int(s), i) for s, i in zip(scores[k], ids) if s > 0)[:5]
        assert [(s, i) for s, _, _, i in found] == expected
    assert pairs == 37 * count and scored <= pairs
    if count == 5000:
        assert scored < 0.5 * pairs


def test_tree_nodes_hold_maxima():
    rows = np.random.default_rng(3).integers(0, 50, (100, 7))
    tree = lexical.Tree.over(rows, 8)
    assert sorted(tree.order) == list(range(100)) and len(tree.levels[-1]) == 1
    for depth, level in enumerate(tree.levels):
        for k, node in enumerate(level):
            below = rows[tree.order[k * 8 << depth : (k + 1) * 8 << depth]]
            assert (node == below.max(axis=0)).all()
