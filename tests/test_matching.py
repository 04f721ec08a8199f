"""The dictionary join and the regex alignments against brute force in plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from logmill.functions import align
from logmill.operators import dictionary as D
from logmill.operators import scale
from .disk import own_folder, prose, stored_bytes

W = "<*>"


def strict_match(template, line):
    """Token search: a wildcard may only end before the first occurrence of the next token."""
    t, i = template, 0
    for n, token in enumerate(t):
        if token == W:
            if n == len(t) - 1:
                return True
            if t[n + 1] not in line[i:]:
                return False
            i += line[i:].index(t[n + 1])
        else:
            if i >= len(line) or line[i] != token:
                return False
            i += 1
    return i == len(line)


def relaxed_match(template, line):
    body = "".join("(?:[^ ]+ )*" if t == W else re.escape(t) + " " for t in template)
    return re.fullmatch(body, "".join(t + " " for t in line)) is not None


def best(templates, line, covers):
    hits = [
        (-sum(t != W for t in tokens), sum(t == W for t in tokens), i)
        for i, tokens in templates.items()
        if covers(tokens, line)
    ]
    return min(hits)[2] if hits else None


def random_case(seed):
    rng = random.Random(seed)
    templates = set()
    while len(templates) < 40:
        tokens = [rng.choice(["a", "b", "c", "d", W, W]) for _ in range(rng.randint(1, 6))]
        tokens = [t for i, t in enumerate(tokens) if not (t == W and i and tokens[i - 1] == W)]
        if tokens != [W]:
            templates.add(" ".join(tokens))
    lines = {" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(400)}
    return templates, lines


def check(spark, strict, covers):
    templates, lines = random_case(5 if strict else 6)
    known = D.add_templates(
        D.empty_dictionary(spark), spark.createDataFrame([(t,) for t in templates], ["template"])
    )
    ids = {r.template_id: r.template.split() for r in known.collect()}
    assert sorted(ids) == list(range(len(templates)))
    logs = spark.createDataFrame([(line,) for line in lines], ["Content"])
    found = D.match_dictionary(logs, D.index_dictionary(known, strict)).collect()
    assert len(found) == len(lines)
    for row in found:
        assert row.template_id == best(ids, row.Content.split(), covers), row


def test_strict(spark):
    check(spark, True, strict_match)


def test_relaxed(spark):
    check(spark, False, relaxed_match)


def test_salted_join_agrees(spark, monkeypatch):
    monkeypatch.setattr(D, "is_small", lambda df: False)
    check(spark, True, strict_match)


def test_first_occurrence(spark):
    known = D.add_templates(
        D.empty_dictionary(spark), spark.createDataFrame([("a <*> b c",)], ["template"])
    )
    logs = spark.createDataFrame([("a x b c",), ("a b x b c",)], ["Content"])
    strict = D.match_dictionary(logs, D.index_dictionary(known))
    relaxed = D.match_dictionary(logs, D.index_dictionary(known, strict=False))
    assert {r.Content: r.template_id for r in strict.collect()} == {"a x b c": 0, "a b x b c": None}
    assert {r.Content: r.template_id for r in relaxed.collect()} == {"a x b c": 0, "a b x b c": 0}


def test_long_lines(spark):
    """Thousands of wildcards in one template, and thousands of tokens under one wildcard."""
    many = " ".join(f"k{i} <*>" for i in range(3000))
    known = D.add_templates(
        D.empty_dictionary(spark), spark.createDataFrame([(many,), ("x <*> y",)], ["template"])
    )
    lines = [" ".join(f"k{i} v{i}" for i in range(3000)), "x " + "w " * 20000 + "y"]
    logs = spark.createDataFrame([(line,) for line in lines], ["Content"])
    found = D.match_dictionary(logs, D.index_dictionary(known), params=True).collect()
    by_first = {r.Content[0]: r for r in found}
    assert by_first["k"].template == many
    assert by_first["k"].params == [f"v{i}" for i in range(3000)]
    assert by_first["x"].template == "x <*> y"
    assert len(by_first["x"].params[0].split()) == 20000


def lazy_regex(template):
    return re.compile("^" + "(.*?)".join(re.escape(p) for p in template.split(W)) + "$")


def lazy_captures(log, template):
    found = lazy_regex(template).search(log)
    return list(found.groups()) if found and found.groups() else None


def test_captures(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        template = "".join(rng.choice(["a", "b", " ", ".", W, "$", "\\", "\n"]) for _ in range(rng.randint(1, 8)))
        log = "".join(rng.choice("ab .$\\x\x01\x02\n") for _ in range(rng.randint(0, 10)))
        filled = "".join(
            p + rng.choice(["", "a", "b b", "x.\x01", "\n"]) for p in template.split(W)
        )
        rows += [(log, template), (filled, template)]
    df = spark.createDataFrame(rows, ["log", "template"])
    own = align.extract_params(F.col("log"), F.col("template")).alias("p")
    covered = align.matches_template(F.col("log"), F.col("template")).alias("m")
    for row in df.select("log", "template", own, covered).collect():
        assert row.p == lazy_captures(row.log, row.template), row
        assert row.m == bool(lazy_regex(row.template).search(row.log)), row


def test_abstraction(spark):
    rng = random.Random(4)
    rows = [("a <*> c", "a b c"), ("a <*>", "a b c"), ("a <*>:<*> c", "a x:y c"), ("a", None), ("<*> b", "a  b")]
    rows += [
        tuple("".join(rng.choice(kinds) for _ in range(rng.randint(0, 7))) for kinds in (["a", ":", " ", "\t", W], ["a", "b", ":", " ", "\n", W]))
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "x string, y string")
    for row in df.select("x", "y", align.is_abstract(F.col("x"), F.col("y")).alias("m")).collect():
        body = re.escape(row.x).replace(re.escape(W), r"\S+?").replace("\\ ", r"\s+")
        assert row.m == (row.y is not None and bool(re.search(f"^{body}$", row.y, re.ASCII))), row


def test_one_answer_for_any_number_of_wildcards(spark):
    rows = []
    for n in (0, 199, 201, 5000):
        template = " ".join(["k <*>"] * n + ["end"])
        line = " ".join(["k v"] * n + ["end"])
        rows += [(n, template, line, True), (n, template, line.replace("v", "v\nw"), n == 0), (n, template, line + "x", False)]
    df = spark.createDataFrame(rows, "n int, template string, log string, expected boolean")
    params = align.extract_params(F.col("log"), F.col("template"))
    for row in df.select("n", "expected", align.matches_template(F.col("log"), F.col("template")).alias("m"), params.alias("p")).collect():
        assert row.m == row.expected
        assert row.p == (["v"] * row.n if row.expected and row.n else None)


def test_long_lines_without_a_match_are_quick(spark):
    line = " ".join(["a"] * 5000)
    df = spark.createDataFrame([(line, " ".join(["<*> a"] * 40) + " zz")], "log string, template string")
    start = time.perf_counter()
    assert not df.select(align.matches_template(F.col("log"), F.col("template"))).first()[0]
    assert time.perf_counter() - start < 5


def test_templates_that_share_every_token(spark):
    """Each token stands in 20 templates or more, but a line tries only those of its own pair."""
    templates = [f"go a{i} b{j} {W} end" for i in range(20) for j in range(20)]
    known = D.add_templates(D.empty_dictionary(spark), spark.createDataFrame([(t,) for t in templates], "template string"))
    index = D.index_dictionary(known)
    lines = [(n, f"go a{n % 20} b{n // 20} x{n} end") for n in range(400)]
    frame = spark.createDataFrame(lines, "_line_id bigint, _text string")
    for small in (True, False):
        assert D._tried(frame, index, small).count() == 400
        found = D.best_templates(frame.select(F.col("_text").alias("Content")), index, small=small).collect()
        assert {(r.Content, r.template) for r in found} == {(t, f"go a{n % 20} b{n // 20} {W} end") for n, t in lines}


def test_shuffled_search_against_brute_force(spark):
    for strict, covers in ((True, strict_match), (False, relaxed_match)):
        templates, lines = random_case(11)
        lines |= {t.replace(W, "a") for t in templates} | {"", "a", "b c"}
        known = D.add_templates(D.empty_dictionary(spark), spark.createDataFrame([(t,) for t in sorted(templates)], "template string"))
        rows = {r.template_id: r.template.split() for r in known.collect()}
        frame = spark.createDataFrame([(t,) for t in sorted(lines)], "Content string")
        for small in (True, False):
            found = D.best_templates(frame, D.index_dictionary(known, strict), small=small).collect()
            expected = {t: best(rows, t.split(), covers) for t in lines}
            assert {r.Content: r.template_id for r in found} == {t: n for t, n in expected.items() if n is not None}


def test_rare_keys_in_large_dictionaries(spark, monkeypatch):
    """All templates share their longest pair of neighbours; a line tries those that share its rarest one."""
    monkeypatch.setattr(D, "BROADCAST_ROWS", 10)
    templates = [f"a b {W} commonword neighbourword {W} x{i} y{i} {W}" for i in range(60)]
    known = D.add_templates(D.empty_dictionary(spark), spark.createDataFrame([(t,) for t in templates], "template string"))
    index = D.index_dictionary(known)
    texts = [f"a b c commonword neighbourword d x{i} y{i} e" for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "_line_id bigint, _text string")
    assert D._tried(frame, index, False).count() == 60
    found = D.best_templates(frame.select(F.col("_text").alias("Content")), index, small=False).collect()
    assert {(r.Content, r.template) for r in found} == set(zip(texts, templates))


def test_matching_keeps_few_copies_of_the_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(D, "is_small", lambda df: False)
    contents = prose(1500)
    cut = [" ".join(W if i % 3 == 2 else w for i, w in enumerate(t.split())) for t in contents]
    with own_folder(spark, monkeypatch, tmp_path):
        known = D.add_templates(D.empty_dictionary(spark), spark.createDataFrame([(t,) for t in cut], "template string"))
        found = D.match_dictionary(spark.createDataFrame([(t,) for t in contents], "Content string"), D.index_dictionary(known))
        assert {(r.Content, r.template) for r in found.collect()} == set(zip(contents, cut))
    assert 0 < stored_bytes(tmp_path) < 4 * sum(map(len, contents))


def test_key_filter_keeps_all_keys(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "key")
    found = scale.key_filter(keys, "key")(spark.range(3000).withColumnRenamed("id", "number"), "number")
    kept = {r.number for r in found.collect()}
    assert kept >= set(range(0, 3000, 3)) and len(kept) < 1200
