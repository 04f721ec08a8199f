"""Compare a Spark query with its SQL text on the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return "NaN"
        return f"{value:.9g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return "NULL" if value is None else str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_plain(row[i]) for i in order) for row in rows
    )


def spark_table(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(connection, sql):
    cursor = connection.execute(sql)
    return _table([d[0] for d in cursor.description], cursor.fetchall())


def differences(spark_result, duck_result, limit=3):
    """An empty list if both results are equal, else a few lines about what differs."""
    (spark_columns, spark_rows), (duck_columns, duck_rows) = spark_result, duck_result
    if spark_columns != duck_columns:
        return [f"columns {spark_columns} / {duck_columns}"]
    if spark_rows == duck_rows:
        return []
    only_spark, only_duck = set(spark_rows) - set(duck_rows), set(duck_rows) - set(spark_rows)
    return [
        f"rows {len(spark_rows)} / {len(duck_rows)}",
        *(f"spark {r}" for r in sorted(only_spark)[:limit]),
        *(f"sql   {r}" for r in sorted(only_duck)[:limit]),
    ]
