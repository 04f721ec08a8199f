"""What the operators of this subpackage share: reading, words, stored tables and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scale import running_offsets
from ..session import discard, materialize, scratch_path  # noqa: F401

#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
#: A side is broadcast only if its stored size is no larger than this many bytes.
BROADCAST_BYTES = 8 << 20
#: ... and if it has no more rows than this, since what is stored grows tenfold in memory.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Size of a stored table as Spark's file listing has it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def attach(big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a stored lookup table: broadcast below a bound of bytes and rows, else shuffled (hot keys are split at run time)."""
    small = stored_bytes(lookup) <= BROADCAST_BYTES and lookup.count() <= BROADCAST_ROWS
    return big.join(F.broadcast(lookup) if small else lookup, list(on), how)


def in_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort by ranges and store; ``_part`` and ``_place`` then tell the block of a row and its place there."""
    return materialize(df.orderBy(*order)).select(
        "*",
        F.spark_partition_id().alias("_part"),
        # the low 33 bits count the rows inside a partition
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name`` = 0, 1, … in the given order, without sending the rows through one task."""
    placed = in_order(df, order)
    offsets = running_offsets(placed.groupBy("_part").agg(F.count("*").alias("n")), ["_part"])
    # one row per partition
    return placed.join(F.broadcast(offsets.select("_part", "_offset")), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_place")).alias(name)
    )


def running_total(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str], size: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``size`` over the rows before, in the order (block, order) of each group.

    Only a block is sorted in one task; the totals of the blocks before it are summed over one row per block.
    """
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        df.groupBy(*group, block)
        .agg(F.sum(size).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    placed = df.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return placed.join(blocks, [*group, block]).select(
        *df.columns, (F.col("_inside") + F.col("_before")).alias(name)
    )
