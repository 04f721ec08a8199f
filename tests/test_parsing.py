"""Parsing in batches and streams."""

import random

import pytest
from pyspark.sql import functions as F

from logmill.functions.align import tags_to_template
from logmill.functions.correct import correct_template_parse
from logmill.functions.text import finer_tokens, fine_tokens, tagger_tokens
from logmill.operators import dictionary as D
from logmill.operators import tagging
from logmill.plans.parse import parse_batch
from logmill.streaming.online import (
    dictionary_at,
    dropped_lines,
    latest_version,
    parse_stream,
    read_raw_log_stream,
)
from .disk import own_folder, prose, stored_bytes


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(f"open file {i} in /tmp/d{i}", "open file <*> in <*>") for i in range(3, 12)]
    rows += [(f"closed by user{i} after {i}ms", "closed by <*> after <*>") for i in range(5, 14)]
    rows += [("service started", "service started"), ("no match", "other <*>")]
    return spark.createDataFrame(rows, ["log", "template"])


@pytest.fixture(scope="module")
def model(samples):
    return tagging.fit_tagger(samples)


def lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "LineId long, Content string")


LOG = [f"open file {i} in /tmp/x{i}" for i in range(50)] + [f"closed by user{i} after {i}ms" for i in range(50)]
LOG += ["service started"] * 40 + ["= 5 =", ""]


def test_batch(spark, model):
    parsed = parse_batch(lines(spark, LOG), model)
    rows = {r.LineId: r for r in parsed.lines.collect()}
    assert len(rows) == len(LOG)
    assert {rows[i].EventTemplate for i in range(50)} == {"open file <*> in <*>"}
    assert {rows[i].EventTemplate for i in range(50, 100)} == {"closed by <*> after <*>"}
    assert {rows[i].EventTemplate for i in range(100, 140)} == {"service started"}
    # no letters: the line keeps its own template, which the dictionary does not take
    assert rows[140].template_id is None and rows[140].EventTemplate is not None
    counters = parsed.counters.first()
    assert (counters.n_lines, counters.n_distinct, counters.model_calls) == (len(LOG), 103, 103)


def test_batch_does_not_depend_on_partitioning(spark, model):
    once = parse_batch(lines(spark, LOG), model).lines.collect()
    again = parse_batch(lines(spark, LOG[::-1]).repartition(7), model).lines.collect()
    by_content = lambda rows: {(r.Content, r.EventTemplate, r.template_id) for r in rows}
    assert by_content(once) == by_content(again)


@pytest.mark.parametrize("rules", [False, True])
def test_batch_keeps_few_copies_of_the_texts(spark, model, rules, monkeypatch, tmp_path):
    plain = tagging.fit_tagger(spark.createDataFrame([("plain text", "plain text")], "log string, template string"))
    contents = prose(1500)
    with own_folder(spark, monkeypatch, tmp_path):
        parsed = parse_batch(lines(spark, contents), plain if rules else model).lines
        assert parsed.where("template_id IS NOT NULL").count() == len(contents)
    assert 0 < stored_bytes(tmp_path) < 4 * sum(map(len, contents))


def test_induced_templates_are_those_of_the_tags(spark, model):
    odd = ["", " ", None, "open file 7 in /tmp/d7", "a 1 2", "x12ms", "closed by user5 after 7 ms", "<*> 3", "é\u00a0 9", "= 5 ="]
    df = lines(spark, odd)
    tagged = tagging.tag_lines(df, model).select("LineId", correct_template_parse(tags_to_template(F.col("tokens"))).alias("template"))
    induced = tagging.induce_templates(df, model)
    assert induced.columns == ["LineId", "Content", "template", "valid"]
    assert sorted(map(tuple, induced.select("LineId", "template").collect())) == sorted(map(tuple, tagged.collect()))


def test_known_templates_keep_their_id(spark, model):
    known = D.add_templates(
        D.empty_dictionary(spark),
        spark.createDataFrame([("open file <*> in <*>",), ("zzz <*>",)], ["template"]),
    )
    before = {r.template: r.template_id for r in known.collect()}
    parsed = parse_batch(lines(spark, LOG), model, known)
    after = {r.template: r.template_id for r in parsed.dictionary.collect()}
    assert before.items() <= after.items()
    assert sorted(after.values()) == list(range(len(after)))
    assert parsed.counters.first().dictionary_hits == 50


def test_misaligned_labels_are_counted(spark, samples):
    row = tagging.misaligned_count(samples).first()
    assert (row.n_samples, row.n_misaligned) == (20, 1)


def test_one_class_only(spark):
    df = spark.createDataFrame([("a b", "a b")], ["log", "template"])
    assert tagging.fit_tagger(df).intercept < 0


def test_fine_tokens(spark):
    df = spark.createDataFrame([("a=1 (b|c) é9 ,x  y[z] 10.0.0.1",)], ["s"])
    row = df.select(
        fine_tokens(F.col("s")).alias("a"), finer_tokens(tagger_tokens(F.col("s"))).alias("b")
    ).first()
    assert row.a == row.b


def test_stream_goes_on_where_it_stopped(spark, model, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    state, out, progress = (str(tmp_path / n) for n in ("state", "out", "progress"))

    def run():
        stream = read_raw_log_stream(spark, str(incoming), "Apache", files_per_batch=1)
        parse_stream(stream, model, state, out, progress).awaitTermination()

    (incoming / "a.txt").write_text("".join(f"[t] [INFO] open file {i} in /tmp/x\n" for i in range(5)) + "junk\n")
    run()
    first = {r.template: r.template_id for r in dictionary_at(spark, state, 0).collect()}
    (incoming / "b.txt").write_text("[t] [INFO] service started\n[t] [INFO] open file 77 in /x/y\n")
    run()
    second = {r.template: r.template_id for r in dictionary_at(spark, state, 1).collect()}
    assert first.items() <= second.items() and "service started" in second
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 7
    opened = [r for r in rows if r.Content.startswith("open")]
    assert {(r.EventTemplate, r.template_id) for r in opened} == {
        ("open file <*> in <*>", first["open file <*> in <*>"])
    }


def test_only_features_of_the_sample_count(spark):
    from logmill.operators.tagging import place_features

    rng = random.Random(8)
    weights = {rng.randrange(-(1 << 63), 1 << 63): float(k + 1) for k in range(700)}
    model = place_features(weights, 0.0)
    others = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)] + list(range(-20, 20)) + list(set(model.hashes) - set(weights))
    frame = spark.createDataFrame([(h,) for h in [*weights, *others]], "h long")
    found = {r.h: r.w for r in frame.select("h", model.weight_of(F.col("h")).alias("w")).collect()}
    assert all(found[h] == weights.get(h, 0.0) for h in found)


def test_a_stream_of_many_batches_keeps_one_row_per_template(spark, model, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    state, out, progress = (str(tmp_path / n) for n in ("state", "out", "progress"))
    for k in range(4):
        (incoming / f"{k}.txt").write_text(f"[t] [INFO] open file {k} in /tmp/x\n[t] [INFO] phase number{'abcd'[k]} begun\n")
    stream = read_raw_log_stream(spark, str(incoming), "Apache", files_per_batch=1)
    parse_stream(stream, model, state, out, progress, trigger={"availableNow": True}).awaitTermination()
    written = spark.read.parquet(f"{state}/new")
    assert written.count() == written.select("template_id").distinct().count() == dictionary_at(spark, state, 3).count()
    assert dictionary_at(spark, state, 0).count() < written.count()


def test_stream_state_is_compacted_and_removed(spark, model, tmp_path):
    import os

    incoming = tmp_path / "in"
    incoming.mkdir()
    state, out, progress = (str(tmp_path / n) for n in ("state", "out", "progress"))
    for k in range(7):
        (incoming / f"{k}.txt").write_text(f"[t] [INFO] phase number{'abcdefg'[k]} begun\njunk {k}\n" + "[t] [INFO] service started\n" * k)
        os.utime(incoming / f"{k}.txt", (1_600_000_000 + k, 1_600_000_000 + k))

    def run(name):
        stream = read_raw_log_stream(spark, str(incoming), "Apache", files_per_batch=1)
        query = parse_stream(stream, model, state, out, str(tmp_path / name), every=2)
        query.awaitTermination()
        return query

    query = run("progress")
    assert [(n, dropped) for _, n, dropped in dropped_lines(query)] == [(2 + k, 1) for k in range(7)]
    assert sorted(os.listdir(f"{state}/whole")) == ["version=3", "version=5"]
    assert sorted(os.listdir(f"{state}/new")) == ["version=4", "version=5", "version=6"]
    rows = sorted(map(tuple, dictionary_at(spark, state, 6, every=2).collect()))
    assert len(rows) == 8 and len({r[0] for r in rows}) == 8
    assert latest_version(spark, state) == 6
    run("again")  # the same batches once more, over the state that is left
    assert sorted(map(tuple, dictionary_at(spark, state, 6, every=2).collect())) == rows


def test_first_lines_read_few_splits(spark, tmp_path, monkeypatch):
    from logmill.sources import raw

    for k in range(40):
        (tmp_path / f"log-{k:02d}.txt").write_text("".join(f"[t] [INFO] line {k} {j}\n" for j in range(50)) + "junk\n")
    path, lines = str(tmp_path), [f"line {k} {j}" for k in range(40) for j in range(50)]
    for head_rows in (raw.HEAD_ROWS, 0):
        monkeypatch.setattr(raw, "HEAD_ROWS", head_rows)
        for n in (1, 51, 52, 300, 100_000):
            found = raw.read_raw_log(spark, path, "Apache", limit=n).orderBy("LineId").collect()
            matching = min(n, 40 * 51) - min(n, 40 * 51) // 51
            assert [(r.LineId, r.Content) for r in found] == list(enumerate(lines[:matching], 1))
    # only as many files as hold the lines are opened
    monkeypatch.setattr(raw, "HEAD_ROWS", 0)
    plan = raw.first_lines(spark, path, 60)
    assert len(plan.inputFiles()) == 3


def test_counters_are_observed(spark, model, tmp_path):
    from pyspark.sql import Observation

    from logmill.sources import raw

    (tmp_path / "a.txt").write_text("[t] [INFO] a b\njunk\n[t] [INFO] c d\n")
    seen = Observation()
    assert raw.read_raw_log(spark, str(tmp_path), "Apache", observed=seen).count() == 2
    assert seen.get == {"n_lines": 3, "n_dropped": 1}


def test_tags_follow_the_hashed_features_on_odd_lines(spark, model):
    """Lines are scored in Arrow batches; the features and weights are those of Spark's hashes."""
    odd = [*LOG, None, "", "  (Ä5ö)  ", "İ٠ 😀 a b  c", "open file 3", "| |", *(f"open {i} closed x{i}" for i in range(1200))]
    frame = lines(spark, odd)
    plain = finer_tokens(tagger_tokens(F.trim("Content")))
    weights = dict(zip(model.hashes, model.weights))
    single = frame.where("Content NOT LIKE '%  %'").select("LineId", plain.alias("t"), tagging.token_features(plain).alias("f"))
    expected = {
        r.LineId: [int(sum((weights.get(h, 0.0) for h in f), model.intercept) > 0) for f in r.f] for r in single.collect()
    }
    tagged = tagging.tag_lines(frame, model)
    found = {r.LineId: r.tokens and [t.tag for t in r.tokens] for r in tagged.collect()}
    assert {k: found[k] for k in expected} == expected and len(found) == len(odd)
    assert found[len(LOG)] is None and found[len(LOG) + 1] is not None
    # far too many expressions per token before: nothing of the score is left to lambdas
    assert "ArrowEvalPython" in tagged._jdf.queryExecution().toString()
