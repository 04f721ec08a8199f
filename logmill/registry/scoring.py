"""Metrics, summaries and orders on the event fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.align import align_tags
from ..operators import joins, metrics, reports
from ..operators.tagging import labelled_tokens, parameter_vocabulary
from ..plans import evaluate, fixtures, relabel
from ..plans.parse import template_catalog
from . import sql
from .core import query

_COUNTS = """
g AS (SELECT gt, count(DISTINCT pred) AS n_pred, min(pred) AS p, count(*) AS n FROM pairs GROUP BY gt),
q AS (SELECT pred, count(DISTINCT gt) AS n_gt, min(gt) AS t FROM pairs GROUP BY pred),
ok AS (SELECT gt, n FROM g JOIN q ON p = pred WHERE n_pred = 1 AND n_gt = 1)"""


def _scores(correct: str, identified: str, ground: str, names: str) -> str:
    p, r, f = names.split()
    return f"""
      (SELECT {correct})::DOUBLE / (SELECT {identified}) AS "{p}",
      (SELECT {correct})::DOUBLE / (SELECT {ground}) AS "{r}",
      CASE WHEN (SELECT {correct}) = 0 THEN 0.0 ELSE round(2 * ((SELECT {correct})::DOUBLE / (SELECT {identified}))
        * ((SELECT {correct})::DOUBLE / (SELECT {ground})) / (((SELECT {correct})::DOUBLE / (SELECT {identified}))
        + ((SELECT {correct})::DOUBLE / (SELECT {ground}))), 6) END AS "{f}\""""


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else c for c in df.columns))


_ALL_PRED, _ALL_GT = "count(*) FROM q", "count(*) FROM g"
_SEEN_PRED = "count(DISTINCT pred) FROM pairs WHERE gt IN (SELECT template FROM seen)"
_SEEN_GT = "count(*) FROM seen"
_EXACT = "count(*) FROM q WHERE n_gt = 1 AND pred = t"


@query(
    "grouping_accuracy",
    sql.on_events(
        'SELECT (SELECT sum(n) FROM ok)::DOUBLE / (SELECT count(*) FROM pairs) AS "GA",'
        + _scores("count(*) FROM ok", _ALL_PRED, _ALL_GT, "PGA RGA FGA"),
        _COUNTS,
    ),
)
def grouping_accuracy(spark, sf_dir):
    return _rounded(metrics.grouping_accuracy(fixtures.pairs(spark, sf_dir)), "FGA")


_SEEN_OK = "count(*) FROM ok WHERE gt IN (SELECT template FROM seen)"


@query(
    "grouping_accuracy_filtered",
    sql.on_events(
        """SELECT (SELECT sum(n) FROM ok WHERE gt IN (SELECT template FROM seen))::DOUBLE
          / (SELECT count(*) FROM pairs WHERE gt IN (SELECT template FROM seen)) AS "GA","""
        + _scores(_SEEN_OK, _SEEN_PRED, _SEEN_GT, "PGA RGA FGA"),
        _COUNTS,
    ),
)
def grouping_accuracy_filtered(spark, sf_dir):
    seen = fixtures.seen_templates(spark, sf_dir)
    scores = metrics.grouping_accuracy(
        fixtures.pairs(spark, sf_dir), filter_templates=seen
    )
    return _rounded(scores, "FGA")


@query(
    "parsing_accuracy",
    sql.on_events('SELECT avg((gt = pred)::INT) AS "PA" FROM pairs'),
)
def parsing_accuracy(spark, sf_dir):
    return metrics.parsing_accuracy(fixtures.pairs(spark, sf_dir)).select("PA")


@query(
    "unseen_parsing_accuracy",
    sql.on_events(
        """SELECT avg((gt = pred)::INT) AS "PA", coalesce(
          avg((gt = pred)::INT) FILTER (gt NOT IN (SELECT template FROM seen)), 0) AS "uPA" FROM pairs"""
    ),
)
def unseen_parsing_accuracy(spark, sf_dir):
    return metrics.parsing_accuracy(
        fixtures.pairs(spark, sf_dir), seen=fixtures.seen_templates(spark, sf_dir)
    )


# the prediction with the glued wildcard blanked, so that the loose comparison has something to accept
_BLANKED = """blanked AS (SELECT gt, CASE WHEN length(gt) % 2 = 0 THEN replace(pred, 'amount=<*>', '<*>') ELSE pred END AS pred
  FROM pairs),
loosened AS (SELECT *, array_to_string(list_transform(string_split(gt, ' '), lambda w:
    CASE WHEN contains(w, '<*>') THEN '<*>' ELSE w END), ' ') AS gt_loose,
  array_to_string(list_transform(string_split(pred, ' '), lambda w:
    CASE WHEN contains(w, '<*>') THEN '<*>' ELSE w END), ' ') AS pred_loose FROM blanked)"""


def _blanked(spark, sf_dir):
    blanked = F.regexp_replace("pred", r"amount=<\*>", "<*>")
    return fixtures.pairs(spark, sf_dir).withColumn(
        "pred", F.when(F.length("gt") % 2 == 0, blanked).otherwise(F.col("pred"))
    )


@query(
    "parsing_accuracy_loose",
    sql.on_events(
        """SELECT avg((gt_loose = pred)::INT) AS "PA_loose" FROM loosened
        WHERE gt IN (SELECT template FROM seen)""",
        _BLANKED,
    ),
)
def parsing_accuracy_loose(spark, sf_dir):
    return metrics.parsing_accuracy_loose(
        _blanked(spark, sf_dir), fixtures.seen_templates(spark, sf_dir)
    )


@query(
    "template_accuracy",
    sql.on_events(
        "SELECT (SELECT count(*) FROM q) AS identified_templates, (SELECT count(*) FROM g) AS ground_templates,"
        + _scores(_EXACT, _ALL_PRED, _ALL_GT, "PTA RTA FTA"),
        _COUNTS,
    ),
)
def template_accuracy(spark, sf_dir):
    return _rounded(metrics.template_accuracy(fixtures.pairs(spark, sf_dir)), "FTA")


@query(
    "template_accuracy_filtered",
    sql.on_events(
        f"SELECT (SELECT {_SEEN_PRED}) AS identified_templates, (SELECT {_SEEN_GT}) AS ground_templates,"
        + _scores(_EXACT + " AND pred IN (SELECT template FROM seen)", _SEEN_PRED, _SEEN_GT, "PTA RTA FTA"),
        _COUNTS,
    ),
)
def template_accuracy_filtered(spark, sf_dir):
    scores = metrics.template_accuracy(
        fixtures.pairs(spark, sf_dir), filter_templates=fixtures.seen_templates(spark, sf_dir)
    )
    return _rounded(scores, "FTA")


@query(
    "template_accuracy_loose",
    sql.on_events(
        "SELECT (SELECT count(*) FROM lq) AS identified_templates, (SELECT count(DISTINCT gt) FROM loosened) AS ground_templates,"
        + _scores(
            "count(*) FROM lq WHERE n_gt = 1 AND pred_loose = t",
            "count(*) FROM lq",
            "count(DISTINCT gt) FROM loosened",
            "PTA RTA FTA",
        ),
        _BLANKED,
        "lq AS (SELECT pred, min(pred_loose) AS pred_loose, count(DISTINCT gt) AS n_gt, min(gt) AS t FROM loosened GROUP BY pred)",
    ),
)
def template_accuracy_loose(spark, sf_dir):
    """Scored with truth and prediction swapped, so that the blanked side is the reference one."""
    scores = metrics.template_accuracy(_blanked(spark, sf_dir), loose=True)
    return _rounded(scores, "FTA")


def _normalized(source: str, name: str) -> str:
    fixed = sql.correct_metric('lower("EventTemplate")')
    return f"""{name} AS (SELECT "LineId", {fixed} AS t FROM {source})"""


# no wildcard of the event templates is ever empty, so aligning them changes nothing
_NORMALIZED = (
    _normalized("event_log", "nt")
    + ","
    + _normalized("event_pred", "np")
    + ", npairs AS (SELECT nt.t AS gt, np.t AS pred FROM nt JOIN np ON nt.\"LineId\" = np.\"LineId\")"
    + f", nseen AS (SELECT DISTINCT {sql.correct_metric('lower(template)')} AS template FROM seen)"
)


def _all_scores(normalized: str) -> str:
    body = (
        """SELECT (SELECT count(*) FROM q) AS identified_templates, (SELECT count(*) FROM g) AS ground_templates,
        (SELECT sum(n) FROM ok)::DOUBLE / (SELECT count(*) FROM npairs) AS "GA",
        (SELECT avg((gt = pred)::INT) FROM npairs) AS "PA",
        (SELECT coalesce(avg((gt = pred)::INT), 0) FROM npairs WHERE gt NOT IN (SELECT template FROM nseen)) AS "uPA","""
        + _scores("count(*) FROM ok", _ALL_PRED, _ALL_GT, "PGA RGA FGA")
        + ","
        + _scores(_EXACT, _ALL_PRED, _ALL_GT, "PTA RTA FTA")
    )
    whole = sql.on_events(body, normalized, _COUNTS.replace("FROM pairs", "FROM npairs"))
    first = "SELECT (SELECT count(*) FROM q)"
    return whole.replace(first, f'SELECT * EXCLUDE ("PGA", "RGA") FROM ({first}', 1) + ")"


@query("evaluate_all", _all_scores(_NORMALIZED))
def evaluate_all(spark, sf_dir):
    scores = evaluate.evaluate_all(
        fixtures.event_log(spark, sf_dir),
        fixtures.event_pred(spark, sf_dir),
        fixtures.seen_templates(spark, sf_dir),
    )
    return _rounded(scores, "FGA", "FTA")


@query(
    "evaluate_missing_rows",
    _all_scores(
        _NORMALIZED.replace(
            'np.t AS pred FROM nt JOIN np ON nt."LineId" = np."LineId"',
            'coalesce(np.t, \'\') AS pred FROM nt LEFT JOIN np ON nt."LineId" = np."LineId" AND np."LineId" % 3 <> 0',
        )
    ).replace("(SELECT sum(n) FROM ok)", "(SELECT coalesce(sum(n), 0) FROM ok)"),
)
def evaluate_missing_rows(spark, sf_dir):
    """Every third line has no prediction."""
    scores = evaluate.evaluate_all(
        fixtures.event_log(spark, sf_dir),
        fixtures.event_pred(spark, sf_dir).where("LineId % 3 <> 0"),
        fixtures.seen_templates(spark, sf_dir),
    )
    return _rounded(scores, "FGA", "FTA")


_SEEN_BY_COMPONENT = """cseen AS (SELECT DISTINCT "Component", lower("EventTemplate") AS template FROM event_log
  WHERE ("Component" = 'svc0' AND "EventId" IN ('E_signup', 'E_purchase')) OR ("Component" = 'svc1' AND "EventId" = 'E_error')),
cpairs AS (SELECT e."Component", nt.t AS gt, np.t AS pred FROM nt JOIN np ON nt."LineId" = np."LineId"
  JOIN event_log e ON e."LineId" = nt."LineId")"""


@query(
    "evaluate_by_dataset",
    sql.on_events(
        """SELECT "Component", round(avg((gt = pred)::INT), 6) AS "PA",
          round(coalesce(avg((gt = pred)::INT) FILTER (WHERE NOT known), 0), 6) AS "uPA"
        FROM (SELECT p.*, s.template IS NOT NULL AS known FROM cpairs p
          LEFT JOIN cseen s ON s."Component" = p."Component" AND s.template = p.gt) GROUP BY 1""",
        _NORMALIZED,
        _SEEN_BY_COMPONENT,
    ),
)
def evaluate_by_dataset(spark, sf_dir):
    """One score for each component, with its own seen templates; three of them have seen none."""
    log = fixtures.event_log(spark, sf_dir)
    pred = fixtures.event_pred(spark, sf_dir).join(log.select("LineId", "Component"), "LineId")
    first, second = F.col("Component") == "svc0", F.col("Component") == "svc1"
    seen = log.where(
        (first & F.col("EventId").isin("E_signup", "E_purchase")) | (second & (F.col("EventId") == "E_error"))
    )
    scores = evaluate.evaluate_all(log, pred, seen.select("Component", "EventTemplate").distinct(), by=["Component"])
    return scores.select("Component", F.round("PA", 6).alias("PA"), F.round("uPA", 6).alias("uPA"))


@query(
    "evaluate_order_lines",
    # the status letter stays, so the one true template falls apart and nothing is right
    """SELECT count(DISTINCT o_orderstatus) AS identified_templates, 1 AS ground_templates, 0.0 AS "GA", 0.0 AS "PA",
      0.0 AS "FGA", 0.0 AS "FTA", NULL::DOUBLE AS "uPA", 0.0 AS "PTA", 0.0 AS "RTA"
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def evaluate_order_lines(spark, sf_dir):
    """All metrics of the order lines against their own corrected texts."""
    from ..functions.correct import correct_template_parse

    truth = fixtures.order_log(spark, sf_dir)
    own = truth.withColumn("EventTemplate", correct_template_parse(F.col("Content")))
    return evaluate.evaluate_all(truth, own)


_BY_COMPONENT = """
cg AS (SELECT "Component", gt, count(DISTINCT pred) AS n_pred, min(pred) AS p, count(*) AS n FROM pairs GROUP BY ALL),
cq AS (SELECT "Component", pred, count(DISTINCT gt) AS n_gt, min(gt) AS t FROM pairs GROUP BY ALL),
cok AS (SELECT cg."Component", sum(n) AS lines, count(*) AS groups FROM cg JOIN cq
        ON p = pred AND cg."Component" = cq."Component" WHERE n_pred = 1 AND n_gt = 1 GROUP BY ALL),
metric_rows AS (
  SELECT 'flawed' AS "Parser", "Component" AS "Dataset",
    round(coalesce(max(lines), 0)::DOUBLE / count(*), 6) AS "GA",
    round(avg((gt = pred)::INT), 6) AS "PA" FROM pairs LEFT JOIN cok USING ("Component") GROUP BY ALL
  UNION ALL
  SELECT 'exact', "Component", 1.0, 1.0 FROM pairs GROUP BY ALL)"""


def _metric_rows(spark, sf_dir):
    """GA and PA per component, for the flawed parse and for an exact one."""
    pairs = fixtures.pairs(spark, sf_dir).withColumnRenamed("Component", "Dataset")
    flawed = metrics.score(pairs, by=["Dataset"]).withColumn("Parser", F.lit("flawed"))
    exact = metrics.score(pairs.withColumn("pred", F.col("gt")), by=["Dataset"]).withColumn(
        "Parser", F.lit("exact")
    )
    return flawed.unionByName(exact).select(
        "Parser", "Dataset", F.round("GA", 6).alias("GA"), F.round("PA", 6).alias("PA")
    )


@query("metrics_by_dataset", sql.on_events("SELECT * FROM metric_rows", _BY_COMPONENT))
def metrics_by_dataset(spark, sf_dir):
    return _metric_rows(spark, sf_dir)


@query(
    "summary_average",
    sql.on_events(
        """SELECT "Dataset", "GA", "PA" FROM metric_rows WHERE "Parser" = 'flawed'
        UNION ALL SELECT 'Average', round(avg("GA"), 3), round(avg("PA"), 3) FROM metric_rows
        WHERE "Parser" = 'flawed'""",
        _BY_COMPONENT,
    ),
)
def summary_average(spark, sf_dir):
    rows = _metric_rows(spark, sf_dir).where("Parser = 'flawed'").drop("Parser")
    return reports.summary_average(rows.unionByName(rows))


@query(
    "median_sem",
    sql.on_events(
        """SELECT "Parser", metric, round(median(v), 6) AS median, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem
        FROM (SELECT "Parser", 'GA' AS metric, "GA" AS v FROM metric_rows
              UNION ALL SELECT "Parser", 'PA', "PA" FROM metric_rows) GROUP BY ALL""",
        _BY_COMPONENT,
    ),
)
def median_sem(spark, sf_dir):
    result = reports.median_sem(_metric_rows(spark, sf_dir), ["GA", "PA"])
    return _rounded(result, "median", "sem")


@query(
    "mean_runtime",
    """SELECT round(avg(a), 6) AS "TrainingTime", round(avg(b), 6) AS "ParsingTime", round(avg(c), 6) AS "ModelTime"
    FROM (SELECT sum(CASE WHEN event_type = 'signup' THEN value ELSE 0 END) AS a,
                 sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS b,
                 sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS c FROM events GROUP BY user_id)""",
)
def mean_runtime(spark, sf_dir):
    """The mean of three cost columns over many records, one record per user."""
    spent = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0))
    times = fixtures.table(spark, sf_dir, "events").groupBy("user_id").agg(
        spent("signup").alias("TrainingTime"),
        spent("purchase").alias("ParsingTime"),
        spent("error").alias("ModelTime"),
    )
    return _rounded(reports.mean_runtime(times), "TrainingTime", "ParsingTime", "ModelTime")


@query(
    "missing_result_row",
    sql.on_events(
        """SELECT d."Dataset", "GA", "PA" FROM (SELECT DISTINCT 'svc' || (user_id % 8) AS "Dataset" FROM events) d
        LEFT JOIN (SELECT * FROM metric_rows WHERE "Parser" = 'flawed') m ON d."Dataset" = m."Dataset\"""",
        _BY_COMPONENT,
    ),
)
def missing_result_row(spark, sf_dir):
    from ..catalog.formats import missing_result_rows

    expected = fixtures.table(spark, sf_dir, "events").select(
        F.concat(F.lit("svc"), F.col("user_id") % 8).alias("Dataset")
    ).distinct()
    rows = _metric_rows(spark, sf_dir).where("Parser = 'flawed'").drop("Parser")
    return missing_result_rows(expected, rows)


@query("pair_truth_prediction", sql.on_events('SELECT "LineId", gt, pred FROM pairs'))
def pair_truth_prediction(spark, sf_dir):
    return joins.pair_truth_prediction(
        fixtures.event_log(spark, sf_dir), fixtures.event_pred(spark, sf_dir)
    )


@query(
    "drop_null_truth",
    sql.on_events("""SELECT "LineId", "EventTemplate" FROM event_log WHERE "Level" <> 'ERROR'"""),
)
def drop_null_truth(spark, sf_dir):
    log = fixtures.event_log(spark, sf_dir).select(
        "LineId", F.when(F.col("Level") != "ERROR", F.col("EventTemplate")).alias("EventTemplate")
    )
    return joins.drop_null_truth(log)


@query(
    "unseen_rows",
    sql.on_events('SELECT "LineId", gt, pred FROM pairs WHERE gt NOT IN (SELECT template FROM seen)'),
)
def unseen_rows(spark, sf_dir):
    rows = fixtures.pairs(spark, sf_dir).select("LineId", "gt", "pred")
    return joins.unseen_rows(rows, fixtures.seen_templates(spark, sf_dir))


@query(
    "seen_rows",
    sql.on_events('SELECT "LineId", gt, pred FROM pairs WHERE gt IN (SELECT template FROM seen)'),
)
def seen_rows(spark, sf_dir):
    rows = fixtures.pairs(spark, sf_dir).select("LineId", "gt", "pred")
    return joins.seen_rows(rows, fixtures.seen_templates(spark, sf_dir))


@query(
    "template_sets",
    sql.on_events(
        """SELECT 'both' AS kind, template FROM (SELECT gt AS template FROM pairs INTERSECT SELECT pred FROM pairs)
        UNION ALL SELECT 'only_truth', template FROM (SELECT gt AS template FROM pairs EXCEPT SELECT pred FROM pairs)
        UNION ALL SELECT 'only_prediction', template FROM (SELECT pred AS template FROM pairs EXCEPT SELECT gt FROM pairs)
        UNION ALL SELECT 'same_lines', pred FROM pairs GROUP BY pred HAVING count(DISTINCT gt) = 1 AND min(gt) = pred"""
    ),
)
def template_sets(spark, sf_dir):
    """Intersection, differences and equality of the two template sets."""
    counts = metrics.pair_counts(fixtures.pairs(spark, sf_dir))
    gt = counts.select(F.col("gt").alias("template"))
    pred = counts.select(F.col("pred").alias("template"))
    same = counts.groupBy("pred").agg(
        F.count(F.lit(1)).alias("n"), F.min("gt").alias("gt")
    ).where((F.col("n") == 1) & (F.col("gt") == F.col("pred")))

    def kind(df, name):
        return df.select(F.lit(name).alias("kind"), "template")

    return (
        kind(gt.intersect(pred), "both")
        .unionByName(kind(gt.subtract(pred), "only_truth"))
        .unionByName(kind(pred.subtract(gt), "only_prediction"))
        .unionByName(kind(same.select(F.col("pred").alias("template")), "same_lines"))
    )


# labels with ids that merge: two templates differ in a boolean word only
_RELABELLED = """relabelled AS (SELECT "LineId", "Content",
  CASE "EventId" WHEN 'E_view' THEN 'E10' WHEN 'E_click' THEN 'E2' ELSE "EventId" END AS "EventId",
  CASE "EventId" WHEN 'E_view' THEN 'user <*> did true amount=<*> key <*>'
    WHEN 'E_click' THEN 'user <*> did false amount=<*> key <*>' ELSE "EventTemplate" END AS "EventTemplate"
  FROM event_log),
mapping AS (SELECT "EventId", "EventTemplate", min("EventId") OVER (PARTITION BY new_template) AS new_id, new_template
  FROM (SELECT DISTINCT "EventId", "EventTemplate", """ + sql.correct_oracle('"EventTemplate"') + """ AS new_template
        FROM relabelled))"""


def _relabelled(spark, sf_dir):
    kind = F.col("EventId")
    return fixtures.event_log(spark, sf_dir).select(
        "LineId",
        "Content",
        F.when(kind == "E_view", "E10").when(kind == "E_click", "E2").otherwise(kind).alias("EventId"),
        F.when(kind == "E_view", "user <*> did true amount=<*> key <*>")
        .when(kind == "E_click", "user <*> did false amount=<*> key <*>")
        .otherwise(F.col("EventTemplate"))
        .alias("EventTemplate"),
    )


@query(
    "merge_corrected_templates", sql.on_events("SELECT * FROM mapping", _RELABELLED)
)
def merge_corrected_templates(spark, sf_dir):
    return relabel.merge_corrected_templates(_relabelled(spark, sf_dir))


@query(
    "correction_report",
    sql.on_events(
        """SELECT count(*) AS n_before, count(DISTINCT new_template) AS n_after,
        count(*) FILTER ("EventTemplate" <> new_template) AS n_changed FROM mapping""",
        _RELABELLED,
    ),
)
def correction_report(spark, sf_dir):
    return relabel.correction_report(relabel.merge_corrected_templates(_relabelled(spark, sf_dir)))


@query(
    "relabel_log",
    sql.on_events(
        """SELECT "LineId", "Content", new_id AS "EventId", new_template AS "EventTemplate", false AS unmapped
        FROM relabelled JOIN mapping USING ("EventId")""",
        _RELABELLED,
    ),
)
def relabel_log(spark, sf_dir):
    return relabel.relabel_log(_relabelled(spark, sf_dir))[0]


@query(
    "relabelled_templates",
    sql.on_events(
        'SELECT DISTINCT new_id AS "EventId", new_template AS "EventTemplate" FROM mapping', _RELABELLED
    ),
)
def relabelled_templates(spark, sf_dir):
    return relabel.relabel_log(_relabelled(spark, sf_dir))[1]


@query(
    "apply_corrections",
    sql.on_events(
        """SELECT "LineId", "Content", coalesce(new_id, r."EventId") AS "EventId",
        coalesce(new_template, r."EventTemplate") AS "EventTemplate", new_id IS NULL AS unmapped
        FROM relabelled r LEFT JOIN (SELECT * FROM mapping WHERE "EventId" <> 'E_signup') m
          ON r."EventId" = m."EventId\"""",
        _RELABELLED,
    ),
)
def apply_corrections(spark, sf_dir):
    """One event type has no mapping and is reported."""
    log = _relabelled(spark, sf_dir)
    mapping = relabel.merge_corrected_templates(log).where("EventId <> 'E_signup'").drop("EventTemplate")
    return joins.apply_corrections(log, mapping)


@query(
    "template_catalog",
    sql.with_ctes(
        """SELECT 'E' || row_number() OVER (ORDER BY n DESC, first) AS "EventID", w AS "EventTemplate", n AS "Occurrence"
        FROM (SELECT s AS w, count(*) AS n, min(id) AS first FROM
          (SELECT "Content" AS s, doc_id * 1000000 + pos AS id FROM doc_lines) GROUP BY s)""",
        sql.DOC_LINES,
    ),
)
def catalog_of_templates(spark, sf_dir):
    """A long catalogue: document lines, taken as the templates of their own."""
    lines = fixtures.doc_lines(spark, sf_dir).select(
        (F.col("doc_id") * 1000000 + F.col("pos")).alias("LineId"),
        F.col("Content").alias("EventTemplate"),
    )
    return template_catalog(lines)


@query(
    "event_ids",
    sql.on_events(
        """SELECT 'E' || row_number() OVER (ORDER BY n DESC, first) AS "EventID", pred AS "EventTemplate", n AS "Occurrence"
        FROM (SELECT pred, count(*) AS n, min("LineId") AS first FROM pairs GROUP BY pred)"""
    ),
)
def event_ids(spark, sf_dir):
    return template_catalog(fixtures.event_pred(spark, sf_dir))


@query(
    "sort_templates",
    sql.on_docs("""SELECT DISTINCT "Content" AS template FROM doc_lines"""),
)
def sort_templates(spark, sf_dir):
    templates = fixtures.doc_lines(spark, sf_dir).select(F.col("Content").alias("template"))
    return reports.sort_templates(templates.distinct())


@query(
    "natural_sort",
    sql.on_events("""SELECT DISTINCT 'E' || "LineId" AS "EventId" FROM event_log"""),
)
def natural_sort(spark, sf_dir):
    ids = fixtures.event_log(spark, sf_dir).select(F.concat(F.lit("E"), "LineId").alias("EventId"))
    return reports.natural_sort(ids.distinct())


@query(
    "top_k",
    sql.on_docs(
        """SELECT token, count(*) AS n FROM (SELECT unnest(string_split("Content", ' ')) AS token FROM doc_lines)
        GROUP BY token ORDER BY n DESC, token LIMIT 20"""
    ),
)
def top_words(spark, sf_dir):
    words = fixtures.doc_lines(spark, sf_dir).select(F.explode(F.split("Content", " ")).alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return reports.top_k(counts, "n", 20, "token")


@query(
    "tag_transitions",
    sql.on_labelled(
        """SELECT prev, tag, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY prev), 6) AS p
        FROM (SELECT tag, coalesce(lag(tag) OVER (PARTITION BY src, "LineId" ORDER BY pos), 'start') AS prev FROM (
          SELECT src, "LineId", unnest(string_split(tags, '')) AS tag, generate_subscripts(string_split(tags, ''), 1) AS pos
          FROM (SELECT src, "LineId", CASE src WHEN 'event' THEN '01000101' ELSE '01010101' END AS tags FROM labelled)))
        GROUP BY prev, tag"""
    ),
)
def tag_transitions(spark, sf_dir):
    tags = F.transform(align_tags(F.col("log"), F.col("template")), lambda t: t["tag"])
    rows = fixtures.labelled(spark, sf_dir).select(tags.alias("tags"))
    return _rounded(metrics.tag_transitions(rows), "p")


@query(
    "tag_report",
    sql.on_labelled(
        """SELECT tag, round(hit::DOUBLE / predicted, 6) AS precision, round(hit::DOUBLE / support, 6) AS recall,
          round(2.0 * hit / (predicted + support), 6) AS f1, support, round(accuracy, 6) AS accuracy FROM (
          SELECT tag, count(*) FILTER (t = tag AND p = tag) AS hit, count(*) FILTER (p = tag) AS predicted,
            count(*) FILTER (t = tag) AS support, avg((t = p)::INT) AS accuracy
          FROM (SELECT t[i]::INT AS t, regexp_matches(w[i], '[0-9]')::INT AS p FROM (
              SELECT CASE src WHEN 'event' THEN ['0','1','0','0','0','1','0','1'] ELSE ['0','1','0','1','0','1','0','1'] END AS t,
                CASE src WHEN 'event' THEN list_concat(string_split(regexp_replace(log, 'amount=', 'amount= '), ' '), [])
                  ELSE string_split(log, ' ') END AS w FROM labelled), range(1, 9) r(i)),
            (VALUES (0), (1)) v(tag) GROUP BY tag)"""
    ),
)
def tag_report(spark, sf_dir):
    """Tags guessed from digits alone, against the labels."""
    tokens = fixtures.labelled(spark, sf_dir).select(
        F.explode(align_tags(F.col("log"), F.col("template"))).alias("t")
    )
    guessed = F.rlike("t.token", F.lit("[0-9]")).cast("int")
    rows = tokens.select(F.col("t.tag").alias("true"), guessed.alias("guess"))
    return _rounded(metrics.tag_report(rows, "true", "guess"), "precision", "recall", "f1", "accuracy")


@query(
    "parameter_vocabulary",
    sql.on_events(
        """, tokens AS (SELECT event_id, unnest([CAST(user_id AS VARCHAR), CAST(cents AS VARCHAR), k]) AS token FROM ev)
        SELECT token, count(*) AS n FROM tokens WHERE event_id % 2 = 1
          AND token IN (SELECT token FROM tokens WHERE event_id % 2 = 0)
        GROUP BY token ORDER BY n DESC, token LIMIT 15"""
    ),
)
def frequent_parameters(spark, sf_dir):
    """Even lines are the training split, odd lines the validation split."""
    log = fixtures.event_log(spark, sf_dir)
    tokens = labelled_tokens(log, "Content", "EventTemplate").withColumn("event_id", F.col("LineId") - 1)
    train, validation = (tokens.where(F.col("event_id") % 2 == r) for r in (0, 1))
    return parameter_vocabulary(train, validation, 15)
