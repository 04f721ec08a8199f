"""Nearest neighbours, related and merged templates, and long lines, against plain versions."""

import random
from collections import Counter

import pytest

from logmill.functions.distance import common_length
from logmill.operators import dictionary as D
from logmill.operators import pairs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def plain_distance(metric, x, y):
    a, b = x.split(), y.split()
    if metric == "lcs":
        return 1 - 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0
    if metric == "levenshtein":
        return levenshtein(x, y) / max(len(x), len(y)) if x or y else 0.0
    if metric == "jaccard":
        both = sum((Counter(a) & Counter(b)).values())
        return 1 - both / (len(a) + len(b) - both) if a or b else 0.0
    both = sum((Counter(x) & Counter(y)).values())
    return 0.0 if x == y else 1 - both / (len(x) * len(y)) ** 0.5 if x and y else 1.0


def random_texts(rng, n):
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(60)] + ["é", "x-y"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(n)] + ["", "same words here"]


def test_bit_parallel_tables():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        assert common_length(a, b) == lcs(a, b)
        assert pairs.edit_distance(a, b) == levenshtein(a, b)
    long = [rng.choice("abcdefgh") for _ in range(300)]
    assert common_length(long, long[::-1]) == lcs(long, long[::-1])
    assert pairs.edit_distance("".join(long), "".join(long[50:])) == 50


@pytest.mark.parametrize("metric", ["jaccard", "cosine", "lcs", "levenshtein"])
@pytest.mark.parametrize("within", [float("inf"), 0.6, 0.3])
def test_references_keep_the_best(metric, within):
    rng = random.Random(3)
    known, asked = sorted(set(random_texts(rng, 80))), random_texts(rng, 60)
    found = pairs.References(metric, known, [t.split() for t in known])
    for x in asked:
        expected = sorted((plain_distance(metric, x, y), r) for r, y in enumerate(known))
        expected = [(d, r) for d, r in expected if d <= within][:3]
        got = found.nearest(x, x.split(), 3, within)
        assert [r for _, r in got] == [r for _, r in expected]
        assert [d for d, _ in got] == pytest.approx([d for d, _ in expected])


@pytest.mark.parametrize("metric, rows", [("levenshtein", 3), ("jaccard", 1000), ("lcs", 7)])
def test_nearest_over_blocks(spark, metric, rows):
    rng = random.Random(5)
    left = [(rng.choice("ab"), t) for t in random_texts(rng, 50)] + [("c", "alone"), ("a", None)]
    right = [(rng.choice("ab"), t) for t in random_texts(rng, 40)] + [("d", "other"), ("a", None)]
    frames = (spark.createDataFrame(r, f"g string, {n} string") for r, n in ((left, "x"), (right, "y")))
    found = pairs.nearest(*frames, metric, 2, ["g"], reference_rows=rows, asking_rows=rows).collect()
    expected = []
    for g, x in {(g, x) for g, x in left if x is not None}:
        near = sorted((plain_distance(metric, x, y), y.encode(), y) for y in {y for h, y in right if h == g and y is not None})
        expected += [(g, x, y, k) for k, (_, _, y) in enumerate(near[:2], 1)]
    assert sorted((r.g, r.x, r.y, r["rank"]) for r in found) == sorted(expected)


def test_related_templates_go_as_deep_as_any(spark):
    rng = random.Random(7)
    words = ["a", "b", "c", "<*>", "<*>"]
    templates = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(60)} - {"<*>"})
    known = D.add_templates(D.empty_dictionary(spark), spark.createDataFrame([(t,) for t in templates], "template string"))
    rows = [(r.template_id, r.template, r.text.split()) for r in known.collect()]
    lines = sorted({" ".join(rng.choice("abcd") for _ in range(rng.randrange(7))) for _ in range(80)}) + ["d " * 3000 + "end", "zz"]
    expected = set()
    for line in lines:
        tokens, depths = line.split(), {}
        for number, template, text in rows:
            depth = 0
            while depth < min(len(text), len(tokens)) and text[depth] in (tokens[depth], "<*>"):
                depth += 1
            depths[number, template] = depth
        best = max(depths.values())
        expected |= {(line, *key, best) for key, depth in depths.items() if depth == best > 0}
    frame = spark.createDataFrame([(t,) for t in lines] + [(None,)], "Content string")
    found = D.related_templates(frame, known).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    assert D.related_templates(frame, D.empty_dictionary(spark)).count() == 0


def test_related_lines_go_down_the_tree_once_per_mask(spark, monkeypatch):
    sizes, store = [], D.materialize

    def counted(df):
        kept = store(df)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(D, "materialize", counted)
    templates = ["user <*> did login from <*>", "user <*> did <*>", "order <*>", "<*> broke"]
    known = D.add_templates(D.empty_dictionary(spark), spark.createDataFrame([(t,) for t in templates], "template string"))
    lines = [f"user {k} did {'login' if k % 2 else 'view'} from {k * 7}" for k in range(900)] + [f"order {k}" for k in range(300)]
    del sizes[:]
    found = D.related_templates(spark.createDataFrame([(t,) for t in lines], "Content string"), known).collect()
    of = {r.template: r.template_id for r in known.collect()}
    expected = []
    for line in lines:
        if line.startswith("order"):
            expected.append((line, of["order <*>"], "order <*>", 2))
        elif "login" in line:
            expected.append((line, of[templates[0]], templates[0], 6))
        else:
            expected.append((line, of[templates[1]], templates[1], 4))
    assert sorted(map(tuple, found)) == sorted(expected)
    # three masks, each at two nodes of a level at most; before, all 1,200 lines were stored at every level
    assert max(sizes) <= 10


@pytest.mark.parametrize("places, rows", [(32, 100_000), (2, 100_000), (32, 4), (0, 100_000)])
def test_related_templates_whatever_is_masked(spark, monkeypatch, places, rows):
    monkeypatch.setattr(D, "_MASKED", places)
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
    dictionary = [(1, "a <*> b c", "a <*> b c"), (1, "a <*> b c", "a <*> b c"), (None, "a x b", "a x b"), (4, None, "<*> x d"), (5, "lost", None), (6, "", "")]
    known = spark.createDataFrame(dictionary, D.DICTIONARY_SCHEMA)
    lines = ["a x b c", "a x b e", "a x b e", "a <*> b c", "<*> x y", "z x d", "z", "c z", "", "a", None]
    found = D.related_templates(spark.createDataFrame([(t,) for t in lines], "Content string"), known).collect()
    expected = set()
    for line in filter(None, lines):
        tokens, depths = line.split(), []
        for n, (_, _, text) in enumerate(dictionary):
            depth = 0
            for t, w in zip((text or "").split(), tokens):
                if t not in (w, "<*>"):
                    break
                depth += 1
            depths.append((depth, n))
        expected |= {(line, n, depth) for depth, n in depths if depth == max(depths)[0] > 0}
    rows = [(line, *dictionary[n][:2], depth) for line, n, depth in expected]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, rows))


def test_merge_against_all_pairs(spark):
    rng = random.Random(9)
    shape = lambda: "go " + " ".join(rng.choice("abcdef") for _ in range(rng.choice([4, 4, 9])))
    old, new = sorted({shape() for _ in range(60)}), sorted({shape() for _ in range(60)})
    known = D.add_templates(D.empty_dictionary(spark), spark.createDataFrame([(t,) for t in old], "template string"))
    rows = {r.template_id: r.template.split() for r in known.collect()}
    taken, rest = {}, []
    for template in (t for t in new if True):
        split = template.split()
        near = sorted((-2 * lcs(split, t) / (len(split) + len(t)), k) for k, t in rows.items() if len(t) == len(split))
        if near and -near[0][0] > 0.7:
            taken.setdefault(near[0][1], []).append(split)
        else:
            rest.append(template)
    merged = {
        " ".join("<*>" if any(t[k] != w for t in taken.get(number, [])) else w for k, w in enumerate(split)) for number, split in rows.items()
    }
    found = D.merge_similar(known, spark.createDataFrame([(t,) for t in new], "template string"), 0.7).collect()
    assert {r.template for r in found} == merged | set(rest)
    assert {r.template_id for r in found} >= set(rows)


@pytest.mark.parametrize("small", [True, False])
def test_lines_of_20000_words(spark, small):
    templates = ["<*> w5x1 <*> end of line", "a <*> c", "start <*> end", "<*> w7x3 <*>"]
    known = D.add_templates(D.empty_dictionary(spark), spark.createDataFrame([(t,) for t in templates], "template string"))
    rows = [(" ".join(f"w{k}x{j}" for k in range(20_000)) + " end of line",) for j in range(4)] + [("a b c",), ("start x end",), ("none",), (None,)]
    found = D.best_templates(spark.createDataFrame(rows, "Content string"), D.index_dictionary(known), small=small).collect()
    assert {(r.Content.split()[-1] + str(len(r.Content) > 100), r.template) for r in found} == {
        ("lineTrue", templates[0]), ("lineTrue", templates[3]), ("cFalse", templates[1]), ("endFalse", templates[2])
    }


def test_edit_distances_of_batches():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé\U0001F600") for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 130, 200, 5)]
    others = ["".join(rng.choice("abcx") for _ in range(n)) for n in (0, 1, 63, 64, 65, 128, 129)]
    assert pairs.edit_distances(texts, others).tolist() == [[pairs.edit_distance(a, b) for b in others] for a in texts]
    found = pairs.References("levenshtein", others, [None] * len(others))
    assert found.few
    single = [(n, d, row) for n, text in enumerate(texts) for d, row in found.nearest(text, None, 3, 0.9)]
    assert sorted(found.nearest_of_all(texts, [None] * len(texts), 3, 0.9), key=lambda r: r[0]) == single
