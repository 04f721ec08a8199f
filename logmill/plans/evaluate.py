"""Score a parse against the ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import drop_empty_wildcards, template_captures, template_parts
from ..functions.binding import let
from ..functions.correct import correct_template_metric
from ..operators.joins import drop_null_truth, pair_truth_prediction
from ..operators.metrics import score
from ..operators.scale import over_distinct


def case_fold(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.lower(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def normalized_side(df: DataFrame, key: str = "LineId", by: Sequence[str] = ()) -> DataFrame:
    """Lower-case one side, correct its templates, and drop the wildcards that match nothing.

    Templates are corrected, and cut at their wildcards, once per distinct template; each line is then searched
    once for the parts.
    """
    side = case_fold(
        df.select(*by, key, "Content", "EventTemplate"), "Content", "EventTemplate"
    )
    fixed = correct_template_metric(F.col("EventTemplate"))

    def prepared(t: Column) -> Column:
        return F.struct(t.alias("template"), template_parts(t).alias("parts"))

    side = over_distinct(side, "EventTemplate", _t=let(prepared, fixed))
    aligned = let(
        lambda t, params: drop_empty_wildcards(t, params),
        F.col("_t.template"),
        template_captures(F.col("Content"), F.col("_t.template"), F.col("_t.parts")),
    )
    return side.select(*by, key, aligned.alias("EventTemplate"))


def normalized_seen(seen: DataFrame, by: Sequence[str] = (), align_seen: bool = False) -> DataFrame:
    """The templates of the labelled sample, lower-cased and corrected, for each dataset if it names one.

    ``align_seen`` also drops the wildcards that match nothing, as the truth's do; the sample then has the columns
    Content and EventTemplate.
    """
    own = [c for c in by if c in seen.columns]
    if align_seen:
        aligned = normalized_side(seen.withColumn("_line", F.lit(0)), "_line", own)
        return aligned.select(*own, F.col("EventTemplate").alias("template")).distinct()
    column = F.col(next(c for c in seen.columns if c not in own))
    return seen.select(*own, correct_template_metric(F.lower(column)).alias("template")).distinct()


def evaluate_all(
    truth: DataFrame,
    prediction: DataFrame,
    seen: DataFrame | None = None,
    key: str = "LineId",
    by: Sequence[str] = (),
    loose: bool = False,
    align_seen: bool = False,
) -> DataFrame:
    """All metrics of a prediction, one row per ``by``.

    Lines without a prediction count as wrong.  ``seen`` may have the ``by`` columns: then each dataset has its own
    seen templates.
    """
    predicted = prediction.fillna("", subset=["EventTemplate"])
    pairs = pair_truth_prediction(
        normalized_side(drop_null_truth(truth), key, by),
        normalized_side(predicted, key, by),
        key,
        by=by,
    )
    return score(pairs, by, None if seen is None else normalized_seen(seen, by, align_seen), loose)


def summary_row(metrics: DataFrame, times: DataFrame | None = None, decimals: int = 3) -> DataFrame:
    """The result row of each dataset, with its times (0 if unknown) and rounded metrics."""
    names = ["GA", "PA", "FGA", "FTA", "uPA", "PTA", "RTA"]
    if times is None:
        timed = metrics.withColumn("TrainingTime", F.lit(0.0)).withColumn("ParsingTime", F.lit(0.0))
    else:
        timed = metrics.join(times.select("Dataset", "TrainingTime", "ParsingTime"), "Dataset", "left")
    zero = F.lit(0.0)
    return timed.select(
        "Dataset",
        F.round(F.coalesce("TrainingTime", zero), decimals).alias("training_time"),
        F.round(F.coalesce("ParsingTime", zero), decimals).alias("parsing_time"),
        "identified_templates",
        "ground_templates",
        *(F.round(c, decimals).alias(c) for c in names),
    )
