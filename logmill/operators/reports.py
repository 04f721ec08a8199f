"""Orders, top lists and summaries over datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def sort_templates(templates: DataFrame, column: str = "template") -> DataFrame:
    """Longest first."""
    return templates.orderBy(F.desc(F.length(column)), column)


def top_k(df: DataFrame, count: str, k: int, *ties: str) -> DataFrame:
    """The rows with the highest counts."""
    return df.orderBy(F.desc(count), *ties).limit(k)


def natural_order(column: str = "EventId") -> list:
    """Sort keys that put E2 before E10, and E1.2 before E1.10: texts and numbers in turn.

    A number is its length and its digits without leading zeros, so numbers of any length compare as such.
    """

    def number(digits):
        plain = F.ltrim(digits, F.lit("0"))
        return F.concat(F.lpad(F.length(plain).cast("string"), 10, "0"), plain)

    texts = F.split(column, r"\d+")
    numbers = F.regexp_extract_all(column, F.lit(r"\d+"), F.lit(0))
    pieces = F.flatten(
        F.zip_with(texts, numbers, lambda t, n: F.when(n.isNull(), F.array(t)).otherwise(F.array(t, number(n))))
    )
    return [pieces, F.col(column)]


def natural_sort(df: DataFrame, column: str = "EventId") -> DataFrame:
    return df.orderBy(*natural_order(column))


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def summary_average(summary: DataFrame, key: str = "Dataset", decimals: int = 3) -> DataFrame:
    """One row per dataset, and a row ``Average`` with the rounded means of the numeric columns."""
    rows = summary.dropDuplicates([key])
    numeric = _numeric(summary)
    mean = rows.agg(*(F.round(F.avg(c), decimals).alias(c) for c in numeric))
    wide = rows.select(*(F.col(c).cast("double") if c in numeric else c for c in rows.columns))
    return wide.unionByName(
        mean.select(F.lit("Average").alias(key), *numeric), allowMissingColumns=True
    )


def median_sem(df: DataFrame, metrics: Sequence[str], by: str = "Parser") -> DataFrame:
    """Median and standard error of each metric over datasets, per parser."""
    values = df.select(
        by, F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics))).alias("metric", "v")
    )
    return values.groupBy(by, "metric").agg(
        F.median("v").alias("median"),
        F.try_divide(F.stddev_samp("v"), F.sqrt(F.count("v").cast("double"))).alias("sem"),
    )


def mean_runtime(times: DataFrame) -> DataFrame:
    return times.agg(
        *(F.avg(c).alias(c) for c in ("TrainingTime", "ParsingTime", "ModelTime"))
    )
