"""Correct the templates of a labelled log and merge those that become equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.correct import correct_template_oracle
from ..operators.joins import apply_corrections
from ..operators.reports import natural_sort


def merge_corrected_templates(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mapping (EventId, EventTemplate) → (new_id, new_template), apart for each value of ``by``.

    The smallest id of equal templates takes over.
    """
    events = (
        log.where(F.col("EventTemplate").isNotNull())
        .select(*by, "EventId", "EventTemplate")
        .distinct()
        .withColumn("new_template", correct_template_oracle(F.col("EventTemplate")))
    )
    canonical = events.groupBy(*by, "new_template").agg(F.min("EventId").alias("new_id"))
    return events.join(canonical, [*by, "new_template"]).select(
        *by, "EventId", "EventTemplate", "new_id", "new_template"
    )


def ambiguous_ids(mapping: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Event ids that stand for more than one template, with their number of templates."""
    return mapping.groupBy(*by, "EventId").agg(F.count("*").alias("n_templates")).where("n_templates > 1")


def correction_report(mapping: DataFrame) -> DataFrame:
    """Templates before, after, and changed by the correction."""
    return mapping.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.countDistinct("new_template").alias("n_after"),
        F.count_if(F.col("EventTemplate") != F.col("new_template")).alias("n_changed"),
    )


def relabel_log(log: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The log with corrected EventId and EventTemplate, and its template list in natural order."""
    mapping = merge_corrected_templates(log, by)
    templates = mapping.select(
        *by, F.col("new_id").alias("EventId"), F.col("new_template").alias("EventTemplate")
    ).distinct()
    return apply_corrections(log, mapping), natural_sort(templates)
