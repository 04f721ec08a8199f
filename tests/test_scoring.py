"""Scores and relabelling where rows are missing, sets differ by dataset, or ids are ambiguous."""

from logmill.operators import clusters, metrics, sampling, scale
from logmill.operators.reports import natural_sort
from logmill.plans.evaluate import evaluate_all, normalized_seen
from logmill.plans.relabel import ambiguous_ids, merge_corrected_templates, relabel_log

LOG = "LineId long, Content string, EventTemplate string"


def test_lines_without_a_prediction_count_as_wrong(spark):
    rows = [(k, f"job {k} done", "job <*> done") for k in range(10)]
    truth, half = spark.createDataFrame(rows, LOG), spark.createDataFrame(rows[:5], LOG)
    score = evaluate_all(truth, half).first()
    assert (score.GA, score.PA) == (0.0, 0.5)


def test_filter_sets_differ_by_dataset(spark):
    pairs = spark.createDataFrame([("a", "x", "x"), ("a", "y", "z"), ("b", "x", "x"), ("b", "y", "y")], "d string, gt string, pred string")
    own = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x")], "d string, t string")
    found = {r.d: r for r in metrics.template_accuracy(pairs, ["d"], own).collect()}
    assert (found["a"].ground_templates, found["a"].FTA) == (1, 1.0) and (found["b"].ground_templates, found["b"].FTA) == (2, 1.0)
    unseen = {r.d: r.uPA for r in metrics.parsing_accuracy(pairs, ["d"], own).collect()}
    assert unseen == {"a": 0.0, "b": 0.0}


def test_relabelling_keeps_systems_and_templates_apart(spark):
    rows = [("s", "E1", "go 5"), ("s", "E1", "stop now"), ("s", "E2", "go <*>"), ("t", "E9", "go <*>"), ("t", "E1", "other")]
    log = spark.createDataFrame(rows, "sys string, EventId string, EventTemplate string")
    mapping = merge_corrected_templates(log, ["sys"])
    assert [(r.EventId, r.n_templates) for r in ambiguous_ids(mapping, ["sys"]).collect()] == [("E1", 2)]
    new, templates = relabel_log(log, ["sys"])
    assert sorted((r.sys, r.EventId, r.EventTemplate) for r in new.collect()) == [
        ("s", "E1", "go <*>"), ("s", "E1", "go <*>"), ("s", "E1", "stop now"), ("t", "E1", "other"), ("t", "E9", "go <*>")
    ]
    assert templates.count() == 4


def test_natural_order_uses_all_numbers(spark):
    ids = ["E1.10", "E1.2", "E01.3", "E10", "E2", "F", "E", "E99999999999999999999999.1", "E1.2b"]
    found = [r.EventId for r in natural_sort(spark.createDataFrame([(i,) for i in ids], "EventId string")).collect()]
    assert found == ["E", "E1.2", "E1.2b", "E01.3", "E1.10", "E2", "E10", "E99999999999999999999999.1", "F"]


def test_seen_templates_can_be_aligned(spark):
    seen = spark.createDataFrame([("a /", "a /<*>")], "Content string, EventTemplate string")
    plain = normalized_seen(seen.select("EventTemplate")).first().template
    assert plain != normalized_seen(seen, align_seen=True).first().template == "a /"


def test_hot_texts_are_split(spark, monkeypatch):
    """Half of all lines have one cleaned text and one word; the parts of a key join like the whole."""
    rows = [(f"worker {k} started", "a") for k in range(60)] + [(f"job {w} ended", "b") for w in "pqrstuvwxyz"]
    df = spark.createDataFrame(rows, "log string, label string")
    expected = sorted(map(tuple, clusters.cluster_lines(df).collect()))
    monkeypatch.setattr(scale, "is_small", lambda df: False)
    monkeypatch.setattr(scale.counted_join, "__kwdefaults__", {"per_task": 7})
    assert sorted(map(tuple, clusters.cluster_lines(df).collect())) == expected
    assert len(expected) == len(rows)


def test_places_in_several_passes():
    assert sampling.allocate([20, 20, 1], 7) == [4, 2, 1]
    assert sampling.allocate([1, 1, 1], 7) == [1, 1, 1]
    assert sampling.allocate([5, 1, 9], 12) == [5, 1, 6]
