"""Structured logs, labelled samples, and result files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.formats import LOG_FORMATS, file_name
from .raw import read_raw_log

_CSV = {"header": "true", "quote": '"', "escape": '"'}


def read_structured(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Structured log in CSV, all columns as strings.

    Files stay splittable unless ``multi_line`` allows line breaks inside quotes.
    """
    return (
        spark.read.options(**_CSV).option("multiLine", str(multi_line).lower()).csv(path)
    )


def write_structured(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    """Write a structured log, or a template list, as CSV or Parquet."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.format(format).save(path)


write_templates = write_structured


def load_dataset(
    spark: SparkSession, directory: str, name: str, format: str = "csv", log_format: str | None = None
) -> DataFrame:
    """A dataset by name: its structured CSV, or its raw text parsed with its line format."""
    base = f"{directory}/{file_name(name)}"
    if format == "csv":
        return read_structured(spark, f"{base}_structured.csv")
    return read_raw_log(spark, base, log_format or LOG_FORMATS[name])


def _first_two_fields(spark: SparkSession, path: str) -> list[str]:
    """The leading field names of a JSON-lines file, in file order, from its first line."""
    first = spark.read.text(path).select(F.expr("json_object_keys(value)")).first()
    if first is None:
        raise ValueError(f"no samples in {path}")
    return list(first[0])[:2]


def read_samples(
    spark: SparkSession,
    train: str,
    validation: str | None = None,
    dev: str | None = None,
    text_col: str | None = None,
    label_col: str | None = None,
) -> DataFrame:
    """JSON-lines splits as log, template, split.  The two fields default to the first two."""
    if text_col is None or label_col is None:
        first, second = _first_two_fields(spark, train)
        text_col, label_col = text_col or first, label_col or second
    result = None
    for split, path in (("train", train), ("validation", validation), ("dev", dev)):
        if path is None:
            continue
        part = (
            spark.read.schema(f"`{text_col}` string, `{label_col}` string")
            .json(path)
            .select(
                F.col(f"`{text_col}`").alias("log"),
                F.col(f"`{label_col}`").alias("template"),
                F.lit(split).alias("split"),
            )
        )
        result = part if result is None else result.unionByName(part)
    return result


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON-lines of (log, template), one folder per shot size."""
    samples.select("shot", "log", "template").write.mode(mode).partitionBy("shot").json(path)


def append_summary(row: DataFrame, path: str) -> None:
    """Append metric rows to a summary."""
    row.write.mode("append").parquet(path)


def upsert_time_cost(row: DataFrame, path: str) -> None:
    """Replace the timing record of the datasets in ``row``; other datasets keep theirs."""
    (
        row.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("Dataset")
        .parquet(path)
    )


def save_run_config(spark: SparkSession, config: dict, path: str) -> None:
    """Keep the settings of the first run."""
    line = spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string")
    line.write.mode("ignore").text(path)
