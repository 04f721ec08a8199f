"""Fixed examples and properties of the text functions and samplers."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logmill.catalog.formats import LOG_FORMATS, compile_format
from logmill.functions import align, correct, distance, text
from logmill.operators import clusters, joins, metrics, reports, sampling
from logmill.plans import evaluate, relabel
from logmill.sources import raw

W = "<*>"


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in df.select("i", expression(F.col("s"))).orderBy("i").collect()]


def test_validity(spark):
    assert column(spark, ["<*> : <*>", "x <*>", "", "é"], text.is_valid_template) == [
        False, True, False, True,
    ]


def test_match_text(spark):
    lines = ["a=(b); c,d", "x<*>y.<*> <*>z", "", "q r  s"]
    assert column(spark, lines, text.match_text) == ["a = ( b ) ; c d", "<*>", "", "q r s"]


def test_corrections(spark):
    given = ["x  true null /a/b 12 v<*>", "True NULL", "<*>.<*>.<*> <*>:<*>", "<*>,<*>"]
    assert column(spark, given, correct.correct_template_parse) == [
        "x <*>", "True NULL", "<*>", "<*>,<*>",
    ]
    assert column(spark, given, correct.correct_template_oracle) == [
        "x <*> <*> <*> <*> <*>", "<*> <*>", "<*> <*>:<*>", "<*>,<*>",
    ]
    assert column(spark, given, correct.correct_template_legacy)[3] == "<*>"
    framed = ["a #<*># #<*># b", "a #<*> #<*> b", "a \"<*>\" '<*>' b", "x/<*>/<*> y"]
    assert column(spark, framed, correct.correct_template_metric) == [
        "a <*> b", "a <*> b", "a <*> b", "x/<*> y",
    ]


def test_corrections_are_idempotent_and_safe_on_long_texts(spark):
    rng = random.Random(1)
    pieces = ["<*>", "a", "12", "/x/y", ".", ":", " ", ",", "true", "#", '"']
    given = ["".join(rng.choice(pieces) for _ in range(12)) for _ in range(300)]
    given += ["<*> " * 20000, "<*>:<*> " * 20000, "/a" * 20000, "9" * 100000]
    for function in (correct.correct_template_parse, correct.correct_template_oracle):
        once = column(spark, given, function)
        assert column(spark, once, function) == once


def test_empty_wildcard_goes(spark):
    df = spark.createDataFrame([("abc ", "abc <*>"), ("q", "w <*>")], ["log", "template"])
    got = [r[0] for r in df.select(align.align_nulls(F.col("log"), F.col("template"))).collect()]
    assert got == ["abc ", "w <*>"]


def test_label_that_does_not_match(spark):
    df = spark.createDataFrame([("a b", "x <*>")], ["log", "template"])
    assert df.select(align.align_tags(F.col("log"), F.col("template"))).first()[0] is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_distances(spark):
    rng = random.Random(2)
    words = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))
    rows = [(words(), words()) for _ in range(200)]
    df = spark.createDataFrame(rows, "x string, y string")
    x, y = F.col("x"), F.col("y")
    got = df.select(
        "x", "y", distance.lcs_distance(x, y).alias("lcs"), distance.jaccard_distance(x, y).alias("jac"),
        distance.cosine_distance(x, y).alias("cos"),
    ).collect()
    for r in got:
        a, b = r.x.split(), r.y.split()
        total = len(a) + len(b)
        assert abs(r.lcs - (1 - 2 * lcs(a, b) / total if total else 0)) < 1e-9
        common = sum((Counter(a) & Counter(b)).values())
        assert abs(r.jac - (1 - common / (total - common) if total else 0)) < 1e-9
        chars = sum((Counter(r.x) & Counter(r.y)).values())
        expected = 0 if r.x == r.y else 1 - (chars / (len(r.x) * len(r.y)) ** 0.5 if r.x and r.y else 0)
        assert abs(r.cos - expected) < 1e-9


def test_min_distance(spark):
    c = spark.createDataFrame([("a b",), ("c",), ("",)], ["t"])
    r = spark.createDataFrame([("a",), ("a b b",)], ["t"])
    got = {row.candidate: row.distance for row in sampling.min_distance(c, r).collect()}
    assert got == {"a b": pytest.approx(1 / 3), "c": 1.0, "": 1.0}
    none = sampling.min_distance(c, r.where("false")).collect()
    assert {row.distance for row in none} == {1e10}


def test_formats(spark):
    for name, fmt in LOG_FORMATS.items():
        compiled = compile_format(fmt)
        assert re.compile(compiled.regex).groups == compiled.n_groups, name
        assert compiled.names == re.findall("<([^<>]+)>", fmt)
    df = spark.createDataFrame([("Jun 1 10:00:00 h sshd[7]: x: y",), ("Jun 1 10:00:00 h su: z",), ("?",)], ["value"])
    rows = {r.Component: (r.PID, r.Content) for r in raw.header_parse(df, "Linux").collect()}
    assert rows == {"sshd": ("7", "x: y"), "su": (None, "z")}


def test_undecodable_bytes_are_left_out(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(b"[t] [INFO] a\xff\xfeb\n[t] [INFO] c\n")
    rows = raw.read_raw_log(spark, str(tmp_path), "Apache").orderBy("LineId").collect()
    assert [(r.LineId, r.Content) for r in rows] == [(1, "ab"), (2, "c")]


def test_line_numbers_over_many_splits(spark, tmp_path):
    for n in range(3):
        lines = [f"[t] [INFO] {n}-{i}" if i % 7 else "bad" for i in range(2000)]
        (tmp_path / f"part-{n}.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = raw.read_raw_log(spark, str(tmp_path), "Apache").orderBy("LineId").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [f"{n}-{i}" for n in range(3) for i in range(2000) if i % 7]
    assert [r.Content for r in rows] == expected
    assert [r.LineId for r in rows] == list(range(1, len(expected) + 1))


def test_quotas():
    assert sampling.allocate([20, 20, 1], 7) == [4, 2, 1]
    assert sampling.allocate([3, 1], 10) == [3, 1]
    assert sampling.allocate([5] * 10, 3) == [1, 1, 1] + [0] * 7


def hot_pool(spark):
    """Half of all lines in one coarse and fine cluster."""
    rows = [(f"alpha beta gamma id{i}", "hot") for i in range(600)]
    rows += [(f"word{'x' * (i % 40)} other{'y' * (i % 7)} ({i})", f"l{i % 5}") for i in range(600)]
    return spark.createDataFrame(rows, ["log", "label"])


def test_stratified_samples(spark):
    pool = hot_pool(spark)
    for options in ({}, {"independent": True}, {"quota": "reference"}):
        drawn = sampling.stratified_sample(pool, [8, 64], seed=3, **options).collect()
        for shot in (8, 64):
            rows = [(r.log, r.label) for r in drawn if r.shot == shot]
            assert len(rows) == len(set(rows)) == shot
        again = sampling.stratified_sample(pool.repartition(5), [8, 64], seed=3, **options).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_adaptive_samples(spark):
    pool = hot_pool(spark)
    drawn = sampling.adaptive_sample(pool, [8, 32], n_candidate=16, seed=1).collect()
    first = min(drawn, key=lambda r: r.pick)
    most_words = max(len(r.log.split()) for r in pool.collect())
    assert len(first.log.split()) == most_words
    small = {(r.pick, r.log) for r in drawn if r.shot == 8}
    large = {(r.pick, r.log) for r in drawn if r.shot == 32}
    assert len(small) == 8 and len(large) == 32 and small < large
    few = sampling.adaptive_sample(pool.limit(5), [8], n_candidate=16).collect()
    assert len({r.log for r in few}) == 5
    assert sampling.cluster_adaptive_sample(pool, 20).count() == 20


def test_metric_properties(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcd"), rng.choice("abcxy")) for _ in range(60)]
    df = spark.createDataFrame(rows, ["gt", "pred"])
    got = metrics.score(df).first()
    groups = {}
    for g, p in rows:
        groups.setdefault(("g", g), set()).add(p)
        groups.setdefault(("p", p), set()).add(g)
    pure = [g for g in "abcd" if len(groups[("g", g)]) == 1 and len(groups[("p", *groups[("g", g)])]) == 1]
    assert got.GA == sum(g in pure for g, _ in rows) / len(rows)
    assert got.PA == sum(g == p for g, p in rows) / len(rows)
    perfect = metrics.score(df.withColumn("pred", F.col("gt"))).first()
    assert [perfect[m] for m in ("GA", "PA", "FGA", "FTA", "PTA", "RTA")] == [1.0] * 6
    nothing = metrics.score(df.withColumn("pred", F.lit("-"))).first()
    assert nothing.FGA == nothing.FTA == nothing.PA == 0.0


def test_empty_filters(spark):
    df = spark.createDataFrame([("a", "a")], ["gt", "pred"])
    none = spark.createDataFrame([], "template string")
    assert metrics.parsing_accuracy(df, seen=df.select("gt")).first().uPA == 0.0
    filtered = metrics.grouping_accuracy(df, filter_templates=none).first()
    assert filtered.GA is None and filtered.FGA == 0.0


def test_evaluation_drops_null_truth_and_fills_null_predictions(spark):
    truth = spark.createDataFrame(
        [(1, "A 1", "a <*>"), (2, "A 2", "a <*>"), (3, "b", None)],
        "LineId int, Content string, EventTemplate string",
    )
    pred = truth.withColumn("EventTemplate", F.when(F.col("LineId") == 1, "A <*>"))
    got = evaluate.evaluate_all(truth, pred).first()
    assert (got.PA, got.ground_templates, got.identified_templates) == (0.5, 1, 2)


def test_merged_templates(spark):
    log = spark.createDataFrame(
        [(1, "Send 123", "E1", "Send 123"), (2, "Send 456", "E2", "Send 456")],
        "LineId int, Content string, EventId string, EventTemplate string",
    )
    lines, templates = relabel.relabel_log(log)
    assert {(r.EventId, r.EventTemplate) for r in lines.collect()} == {("E1", "Send <*>")}
    assert [tuple(r) for r in templates.collect()] == [("E1", "Send <*>")]


def test_natural_sort(spark):
    df = spark.createDataFrame([("E10",), ("E2",), ("E1",)], ["EventId"])
    assert [r[0] for r in reports.natural_sort(df).collect()] == ["E1", "E2", "E10"]


def test_vocabulary_leaves_stop_words_out(spark):
    df = spark.createDataFrame([("the Monday Jan cat cat so of",)], ["clean"])
    assert {tuple(r) for r in clusters.vocabulary(df).collect()} == {("cat", 2)}


def test_unseen_rows(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "q")], ["gt", "pred"])
    seen = spark.createDataFrame([("a",), ("a",)], ["t"])
    assert joins.unseen_rows(df, seen).collect()[0].gt == "b"
    assert joins.seen_rows(df, seen).count() == 1


def test_clusters_beyond_the_head_of_the_vocabulary(spark, monkeypatch):
    """The same keys, however few words the head has; nulls, repeats and lines of few words included."""
    from logmill.operators import clusters

    rng = random.Random(3)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)] + ["to", "the", "Mon", "é" * 3]
    lines = [" ".join(rng.choice(words[: rng.randrange(4, 64)]) for _ in range(rng.randrange(0, 7))) for _ in range(300)]
    rows = [(line + rng.choice(["", ".", "#"]), rng.choice("ab")) for line in lines] + [(None, "a"), ("to the", "b"), ("waa", None)]
    df = spark.createDataFrame(rows, "log string, label string")

    def found():
        keyed = sorted(map(repr, clusters.cluster_lines(df).collect()))
        return keyed, sorted(map(repr, clusters.topk_tokens(clusters.nonempty_clean(df)).collect()))

    whole = found()
    clean = {r.log: r.clean for r in clusters.nonempty_clean(df).collect()}
    counts = Counter(w for line, _ in set(rows) if line in clean for w in clean[line].split() if len(w) > 2 and w not in ("the", "Mon"))
    expected = {
        line: " ".join(sorted(sorted({w for w in text.split() if w in counts}, key=lambda w: (-counts[w], w))[:3])) for line, text in clean.items()
    }
    assert {r.log: r.coarse for r in clusters.cluster_lines(df).collect()} == expected
    for name, value in (("HEAD_WORDS", 0), ("HEAD_WORDS", 7), ("HEAD_BYTES", 60), ("HEAD_WORD_BYTES", 5)):
        with monkeypatch.context() as patch:
            patch.setattr(clusters, name, value)
            assert found() == whole, name


def test_correction_in_steps_is_that_in_one_pass(spark):
    """Constants, digits and words with a wildcard in turn, and merges only where there is a place for one."""
    from logmill.functions import patterns

    rng = random.Random(11)
    pieces = ["<*>", "12", "3", "True", "null", "a", "é٣", "x<*>y", "/a/<*>", "/", ".", ":", "#", '"', "'", " ", "  ", ",", "@", "<", "*>", "user", "1 b"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14)))) for k in range(1500)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, s string")

    def one_pass(col, merges, constants=(), ignore_case=False, paths=False):
        text_ = text.normalize_ws(col)
        if paths:
            text_ = F.regexp_replace(text_, patterns.whole_token(f"(?:/[^/{correct._PATH}]+)++", correct._PATH), "<*>")
        variables = [f"{patterns.DIGIT}++", patterns.wild_piece(f"/{correct._TOKEN}")]
        constants = sorted({c.lower() for c in constants})
        if constants:
            variables.insert(0, f"(?{'iu' if ignore_case else ''}:{'|'.join(patterns.quote(c) for c in constants)})")
        text_ = F.regexp_replace(text_, patterns.whole_token("|".join(variables), correct._TOKEN), "<*>")
        for pattern, replacement in merges:
            text_ = F.regexp_replace(text_, pattern, replacement)
        return text_

    forms = [
        dict(merges=correct._METRIC_MERGES),
        dict(merges=correct._PARSE_MERGES, constants=("true", "null", "user", "1 b"), paths=True),
        dict(merges=correct._LEGACY_MERGES, constants=("true", "null"), ignore_case=True, paths=True),
        dict(merges=correct._ORACLE_MERGES, constants=("true", "a"), ignore_case=True, paths=True),
    ]
    for form in forms:
        found = df.select("id", "s", correct.correct_template(F.col("s"), **form).alias("a"), one_pass(F.col("s"), **form).alias("b")).collect()
        assert [(r.s, r.a) for r in found] == [(r.s, r.b) for r in found]
    plan = df.select(correct.correct_template_metric(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan  # texts without a wildcard pass the merges by
