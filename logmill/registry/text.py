"""Text functions over every line and template of the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import align, correct, distance, text
from ..operators.pairs import nearest, pair_distance
from ..operators.sampling import min_distance
from ..plans import fixtures
from . import sql
from .core import query


def _per_text(name, expression, sql_expression):
    @query(name, sql.per_text(sql_expression))
    def run(spark, sf_dir):
        return fixtures.texts(spark, sf_dir).select(
            "src", "id", expression(F.col("s")).alias("result")
        )


_per_text("normalize_ws", text.normalize_ws, sql.squeeze("s"))
_per_text(
    "valid_template",
    text.is_valid_template,
    r"regexp_matches(replace(replace(s, '<*>', ''), ' ', ''), '[^!-/:-@\[-`{-~]')",
)
_per_text("match_tokens", lambda c: F.array_join(text.match_tokens(c), " "), sql.match_text("s"))
_per_text(
    "similarity_tokens",
    lambda c: F.array_join(text.similarity_tokens(c), " "),
    sql.similarity_text("s"),
)
_per_text(
    "tagger_tokens",
    lambda c: F.array_join(
        F.transform(
            text.tagger_tokens(c),
            lambda t: F.concat(F.when(t["space_before"], " ").otherwise(""), t["token"]),
        ),
        "~",
    ),
    sql.tagger_text("s"),
)
_per_text("correct_template_parse", correct.correct_template_parse, sql.correct_parse("s"))
_per_text("correct_template_legacy", correct.correct_template_legacy, sql.correct_legacy("s"))
_per_text("correct_template_oracle", correct.correct_template_oracle, sql.correct_oracle("s"))
_per_text("correct_template_metric", correct.correct_template_metric, sql.correct_metric("s"))
_per_text(
    "correct_with_user_strings",
    lambda c: correct.correct_template_parse(c, ["user", "Order", "the"]),
    sql.correct_parse("s", ("user", "order", "the")),
)
_per_text(
    "merge_wildcards",
    correct.merge_wildcards,
    r"regexp_replace(" + sql.merged("s", ".") + r", '<\*>([: ]?<\*>)+', '<*>', 'g')",
)
_per_text("template_regex_lazy", align.template_regex_lazy, sql.regex_of("s", "(.*?)"))
_per_text(
    "template_regex_ws",
    align.template_regex_ws,
    f"CASE WHEN contains(s, '<*>') THEN {sql.regex_of('s', '(.*?)', chr(92) + 's+')} END",
)
_per_text(
    "template_regex_token", align.template_regex_token, sql.regex_of("s", r"(\S+?)", r"\s+")
)
_per_text("clean", text.clean, sql.clean("s"))
_per_text("char_signature", text.char_signature, sql.signature("s"))


@query(
    "case_fold",
    sql.on_texts("SELECT src, id, lower(s) AS s FROM texts"),
)
def case_fold(spark, sf_dir):
    from ..plans.evaluate import case_fold as fold

    return fold(fixtures.texts(spark, sf_dir), "s")


_PARAMS = r"""
  CASE src WHEN 'event' THEN regexp_extract(log, '^user (.*?) did .*? amount=(.*?) key (.*?)$', 1) || '|' ||
      regexp_extract(log, '^user (.*?) did .*? amount=(.*?) key (.*?)$', 2) || '|' ||
      regexp_extract(log, '^user (.*?) did .*? amount=(.*?) key (.*?)$', 3)
    ELSE regexp_extract(log, '^order (.*?) status (.*?) by (.*?) at (.*?)$', 1) || '|' ||
      regexp_extract(log, '^order (.*?) status (.*?) by (.*?) at (.*?)$', 2) || '|' ||
      regexp_extract(log, '^order (.*?) status (.*?) by (.*?) at (.*?)$', 3) || '|' ||
      regexp_extract(log, '^order (.*?) status (.*?) by (.*?) at (.*?)$', 4) END"""


@query("extract_params", sql.on_labelled(f'SELECT src, "LineId", {_PARAMS} AS params FROM labelled'))
def extract_params(spark, sf_dir):
    return fixtures.labelled(spark, sf_dir).select(
        "src",
        "LineId",
        F.array_join(align.extract_params(F.col("log"), F.col("template")), "|").alias("params"),
    )


@query(
    "matches_template",
    sql.on_labelled(
        f"""SELECT src, "LineId", regexp_matches(log, {sql.regex_of('template', '(.*?)')}) AS own,
        regexp_matches(log, {sql.regex_of("'user <*> did click amount=<*> key <*>'", '(.*?)')}) AS click
        FROM labelled"""
    ),
)
def matches_template(spark, sf_dir):
    click = F.lit("user <*> did click amount=<*> key <*>")
    return fixtures.labelled(spark, sf_dir).select(
        "src",
        "LineId",
        align.matches_template(F.col("log"), F.col("template")).alias("own"),
        align.matches_template(F.col("log"), click).alias("click"),
    )


@query(
    "align_nulls",
    sql.on_labelled(
        """SELECT src, "LineId", template AS unchanged, template AS doubled, template || ' ' AS trailing
        FROM labelled"""
    ),
)
def align_nulls(spark, sf_dir):
    """Each line against its template, and against templates with one wildcard too many."""
    log, template = F.col("log"), F.col("template")
    doubled = F.regexp_replace(template, "^([^<]*)<", "$1<*><")
    return fixtures.labelled(spark, sf_dir).select(
        "src",
        "LineId",
        align.align_nulls(log, template).alias("unchanged"),
        # of two neighbouring lazy wildcards the first is empty and goes
        align.align_nulls(log, doubled).alias("doubled"),
        align.align_nulls(
            F.concat(log, F.lit(" ")), F.concat(template, F.lit(" <*>"))
        ).alias("trailing"),
    )


@query(
    "is_abstract",
    sql.on_labelled(
        r"""SELECT src, "LineId", src = 'event' AND log LIKE 'user % did view amount=% key %' AS view_covers,
        true AS own_covers, false AS null_covers FROM labelled"""
    ),
)
def is_abstract(spark, sf_dir):
    view = F.lit("user <*> did view amount=<*> key <*>")
    return fixtures.labelled(spark, sf_dir).select(
        "src",
        "LineId",
        align.is_abstract(view, F.col("log")).alias("view_covers"),
        align.is_abstract(F.col("template"), F.col("log")).alias("own_covers"),
        align.is_abstract(F.col("template"), F.lit(None).cast("string")).alias("null_covers"),
    )


_TAGGED = """SELECT 'event' AS src, "LineId", 'user/0 ' || user_id || '/1 did/0 ' || event_type || '/0 amount=/0'
    || cents || '/1 key/0 ' || k || '/1' AS tagged
  FROM event_log JOIN ev USING (event_id)
  UNION ALL
  SELECT 'order', o_orderkey + 1, 'order/0 ' || o_orderkey || '/1 status/0 ' || o_orderstatus || '/1 by/0 '
    || c_name || '/1 at/0 /shop/' || c_nationkey || '/' || o_custkey || '/1'
  FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("align_tags", sql.on_events(_TAGGED))
def align_tags(spark, sf_dir):
    tags = align.align_tags(F.col("log"), F.col("template"))
    return fixtures.labelled(spark, sf_dir).select(
        "src",
        "LineId",
        F.array_join(
            F.transform(
                tags,
                lambda t: F.concat(
                    F.when(t["space_before"], " ").otherwise(""), t["token"], F.lit("/"), t["tag"]
                ),
            ),
            "",
        ).alias("tagged"),
    )


@query("tags_to_template", sql.on_labelled('SELECT src, "LineId", template FROM labelled'))
def tags_to_template(spark, sf_dir):
    """Tags taken from the labels give the templates back."""
    tags = align.align_tags(F.col("log"), F.col("template"))
    return fixtures.labelled(spark, sf_dir).select(
        "src", "LineId", align.tags_to_template(tags).alias("template")
    )


_LOOSE = r"""array_to_string(list_transform(string_split(gt, ' '), lambda w:
  CASE WHEN contains(w, '<*>') THEN '<*>' ELSE w END), ' ')"""


@query(
    "loose_equal",
    sql.on_events(
        f"""SELECT "LineId", {_LOOSE} = pred AS as_predicted,
        {_LOOSE} = replace(gt, 'amount=<*>', '<*>') AS as_blanked FROM pairs"""
    ),
)
def loose_equal(spark, sf_dir):
    return fixtures.pairs(spark, sf_dir).select(
        "LineId",
        text.loose_equal(F.col("gt"), F.col("pred")).alias("as_predicted"),
        text.loose_equal(
            F.col("gt"), F.regexp_replace("gt", r"amount=<\*>", "<*>")
        ).alias("as_blanked"),
    )


def _distance(name, metric, sql_expression=None):
    body = None
    if sql_expression is not None:
        body = sql.on_labelled(
            f'SELECT src, "LineId", round({sql_expression}, 6) AS distance FROM labelled'
        )

    @query(name, body)
    def run(spark, sf_dir):
        pairs = pair_distance(fixtures.labelled(spark, sf_dir), "log", "template", metric)
        return pairs.select("src", "LineId", F.round("distance", 6).alias("distance"))


def _bag_overlap(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_distinct({a}), lambda v: least("
        f"len(list_filter({a}, lambda e: e = v)), len(list_filter({b}, lambda e: e = v)))))"
    )


_LOG_CHARS = "string_split(log, '')"
_TPL_CHARS = "string_split(template, '')"
_LOG_WORDS, _TPL_WORDS = sql.word_list("log"), sql.word_list("template")

_distance(
    "lev_distance",
    "levenshtein",
    "levenshtein(log, template)::DOUBLE / greatest(length(log), length(template))",
)
_distance(
    "cosine_distance",
    "cosine",
    f"1 - {_bag_overlap(_LOG_CHARS, _TPL_CHARS)} / sqrt((length(log) * length(template))::DOUBLE)",
)
_JACCARD = _bag_overlap(_LOG_WORDS, _TPL_WORDS)
_distance(
    "jaccard_distance",
    "jaccard",
    f"1 - {_JACCARD}::DOUBLE / (len({_LOG_WORDS}) + len({_TPL_WORDS}) - {_JACCARD})",
)
# line and template agree in order here, so the longest common subsequence is the common word bag
_distance(
    "lcs_distance",
    "lcs",
    f"1 - 2 * {_JACCARD}::DOUBLE / (len({_LOG_WORDS}) + len({_TPL_WORDS}))",
)


@query(
    "lcs_similarity",
    sql.on_labelled(
        f"""SELECT src, "LineId", round(2 * {_JACCARD}::DOUBLE / (len({_LOG_WORDS}) + len({_TPL_WORDS})), 6)
        AS similarity FROM labelled"""
    ),
)
def lcs_similarity(spark, sf_dir):
    similarity = distance.lcs_similarity(text.words(F.col("log")), text.words(F.col("template")))
    return fixtures.labelled(spark, sf_dir).select(
        "src", "LineId", F.round(similarity, 6).alias("similarity")
    )


# the table of common lengths row by row: one list of hits per word of x, folded into the last row
_LCS_ROWS = """list_reduce(list_prepend(list_transform(y, lambda b: 0), list_transform(x, lambda a:
    list_transform(y, lambda b: CASE WHEN a = b THEN 1 ELSE 0 END))), lambda row, hit: list_transform(range(1, len(hit) + 1), lambda j:
    list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i], CASE WHEN hit[i] = 1 THEN coalesce(row[i - 1], 0) + 1 ELSE 0 END)))))"""


@query(
    "lcs_reversed",
    sql.on_labelled(
        f"""SELECT src, "LineId", round(1 - 2 * list_max({_LCS_ROWS})::DOUBLE / (len(x) + len(y)), 6) AS distance
        FROM (SELECT src, "LineId", {_LOG_WORDS} AS x, list_reverse({_LOG_WORDS}) AS y FROM labelled)"""
    ),
)
def lcs_reversed(spark, sf_dir):
    """Each line with its own words backwards, where only the order of words tells the distance."""
    backwards = F.array_join(F.reverse(text.words(F.col("log"))), " ")
    rows = fixtures.labelled(spark, sf_dir).withColumn("back", backwards)
    return pair_distance(rows, "log", "back", "lcs").select("src", "LineId", F.round("distance", 6).alias("distance"))


@query(
    "template_similarity",
    sql.on_labelled(
        """SELECT src, "LineId", round(c::DOUBLE / (len(a) + len(b) - c), 6) AS similarity FROM (
          SELECT *, len(list_intersect(a, b)) AS c FROM (SELECT src, "LineId", """
        + f"string_split({sql.similarity_text('log')}, ' ') AS a, string_split({sql.similarity_text('template')}, ' ') AS b"
        + " FROM labelled))"
    ),
)
def template_similarity(spark, sf_dir):
    similarity = distance.template_similarity(F.col("log"), F.col("template"))
    return fixtures.labelled(spark, sf_dir).select(
        "src", "LineId", F.round(similarity, 6).alias("similarity")
    )


@query(
    "min_distance",
    sql.on_labelled(
        """SELECT c AS candidate, round(min(1 - o::DOUBLE / (len(a) + len(b) - o)), 6) AS distance FROM (
          SELECT c, a, b, coalesce("""
        + _bag_overlap("a", "b")
        + f""", 0) AS o FROM
            (SELECT DISTINCT log AS c, {_LOG_WORDS} AS a FROM labelled),
            (SELECT DISTINCT {sql.word_list('template')} AS b FROM labelled)) GROUP BY c"""
    ),
)
def min_distances(spark, sf_dir):
    rows = fixtures.labelled(spark, sf_dir)
    result = min_distance(rows.select("log"), rows.select("template").distinct())
    return result.select("candidate", F.round("distance", 6).alias("distance"))


@query(
    "nearest_template",
    sql.on_labelled(
        """SELECT src, x, y, rank FROM (
          SELECT src, x, y, row_number() OVER (PARTITION BY src, x ORDER BY d, y) AS rank FROM (
            SELECT src, log AS x, y, levenshtein(log, y)::DOUBLE / greatest(length(log), length(y)) AS d
            FROM (SELECT DISTINCT src, log FROM labelled)
            JOIN (SELECT DISTINCT src, template AS y FROM labelled) USING (src)))
        WHERE rank <= 2"""
    ),
)
def nearest_template(spark, sf_dir):
    rows = fixtures.labelled(spark, sf_dir)
    left = rows.select("src", F.col("log").alias("x")).distinct()
    right = rows.select("src", F.col("template").alias("y")).distinct()
    return nearest(left, right, "levenshtein", 2, ["src"]).select("src", "x", "y", "rank")
