"""Helpers that keep plans safe at scale: checked broadcasts, salted joins, distributed row numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, stored

#: A side is broadcast only if it is known to hold no more rows than this.
BROADCAST_ROWS = 100_000
#: ... and whose values, written as text, take no more bytes than this.
BROADCAST_BYTES = 64 << 20
SALTS = 32
#: Rows of one key that a task of a counted join takes.
ROWS_PER_TASK = 1_000_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Check rows and bytes of a (materialised or cheap) DataFrame; at most ``max_rows`` + 1 rows are looked at."""
    head = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("size"))
    found = head.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    return found.rows <= max_rows and found.bytes <= max_bytes


def spread_if_small(df: DataFrame, max_bytes: int = 256 << 20) -> DataFrame:
    """Spread a small scan over all cores.

    A small file is one task, however costly the text work on its rows.  Scans above ``max_bytes`` have
    enough splits of their own and stay as they are.
    """
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    if size > max_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def checked_join(
    big: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    condition: Column | None = None,
    *,
    salt_by: Column,
    small: bool,
    salts: int = SALTS,
) -> DataFrame:
    """Inner equi-join with a lookup side.

    A lookup of checked size is broadcast.  Otherwise every lookup row is copied to ``salts`` buckets and
    the big side is spread over them by ``salt_by``, so that no key value lands in one task.
    """
    if small:
        joined = big.join(F.broadcast(lookup), list(keys))
    else:
        spread = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
        copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = spread.join(copies, [*keys, "_salt"]).drop("_salt")
    return joined if condition is None else joined.where(condition)


def counted_join(
    big: DataFrame, lookup: DataFrame, key: str, rows: str, *, salt_by: Column, per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Inner equi-join with a stored lookup side that knows, in ``rows``, how many big rows each key has.

    A lookup of checked size is broadcast.  Otherwise each key with more than ``per_task`` rows is split into as many
    parts as that takes; such keys are few, for their rows together are no more than the table.
    """
    if is_small(lookup):
        return big.join(F.broadcast(lookup.drop(rows)), key)
    parts = F.ceil(F.col(rows) / F.lit(per_task)).cast("int")
    hot = materialize(lookup.where(F.col(rows) > per_task).select(key, parts.alias("_parts")))
    marked = big.join(F.broadcast(hot) if is_small(hot) else hot, key, "left")
    salt = F.pmod(F.xxhash64(salt_by), F.coalesce("_parts", F.lit(1))).cast("int")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(rows)
    return marked.withColumn("_salt", salt).drop("_parts").join(copies, [key, "_salt"]).drop("_salt")


def running_offsets(sizes: DataFrame, order: Sequence[str], size: str = "n") -> DataFrame:
    """Rows before each block.  ``sizes`` holds one row per block (file split, partition), not per line."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def with_sequence(df: DataFrame, order: Sequence[Column], name: str, start: int = 1, **new: Column) -> DataFrame:
    """Number the rows ``start, start+1, …`` in the given order without sending them through one task.

    The rows are range-partitioned and sorted, written out once, and numbered by their place in the
    partition plus the sizes of the partitions before it.  ``new`` columns are computed behind the sort, so that they are
    not shuffled.
    """
    placed = df.orderBy(*order).select(
        "*",
        *(c.alias(n) for n, c in new.items()),
        F.spark_partition_id().alias("_part"),
        # the low 33 bits count the rows inside a partition
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )
    placed = stored(placed, "sequence")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    offsets = materialize(running_offsets(sizes, ["_part"]).select("_part", "_offset"))
    # one row per partition
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, *new, (F.col("_offset") + F.col("_place") + start).alias(name)
    )


def digest(text: Column) -> Column:
    """16 bytes that stand for a text in joins: of SHA-256, so that no two texts share them."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


#: A filter has so many bits for each key, and no more than this in all; keys beyond that let more rows pass.
FILTER_BITS_PER_KEY, FILTER_BITS = 32, 1 << 28


def key_filter(keys: DataFrame, key: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that leaves of a table the rows whose column may be among the stored ``keys``; few others pass.

    The filter is a broadcast bitmap of the keys' hashes, in rows of 4,096 bits.
    """
    wanted = max(keys.count() * FILTER_BITS_PER_KEY, 1 << 12)
    size = min(1 << (wanted - 1).bit_length(), FILTER_BITS)

    def probed(df: DataFrame, column: str) -> DataFrame:
        words = (
            keys.select(_place(F.col(key), size).alias("_at"))
            .groupBy(F.expr("shiftright(_at, 6)").alias("_word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(_at & 63 as int)))").alias("_value"))
        )
        placed = df.withColumn("_at", _place(F.col(column), size)).withColumn("_word", F.expr("shiftright(_at, 6)"))
        met = _looked_up(placed, words, "inner")
        return met.where("(shiftright(_value, cast(_at & 63 as int)) & 1L) = 1L").select(*df.columns)

    return probed


def _place(key: Column, size: int) -> Column:
    """Of ``size`` places, a power of two, the one of a key."""
    return F.xxhash64(key).bitwiseAND(F.lit(size - 1).cast("long"))


def _looked_up(df: DataFrame, words: DataFrame, how: str) -> DataFrame:
    """Add the ``_value`` that a broadcast table of few numbers has for ``_word``; it is sent in rows of 64 numbers."""
    blocks = words.groupBy(F.expr("shiftright(_word, 6)").alias("_block")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.expr("cast(_word & 63 as int)"), "_value"))).alias("_map")
    )
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("_map")[i], F.lit(0).cast("long")))
    blocks = F.broadcast(blocks.select("_block", values.alias("_values")))
    met = df.withColumn("_block", F.expr("shiftright(_word, 6)")).join(blocks, "_block", how)
    return met.withColumn("_value", F.expr("get(_values, cast(_word & 63 as int))")).drop("_block", "_values")


#: Counts of keys that share a place are added up.
COUNTED_PLACES = 1 << 20


def with_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add about how many rows have this key: at least so many, and null for a null key."""
    words = df.where(F.col(key).isNotNull()).groupBy(_place(F.col(key), COUNTED_PLACES).alias("_word")).agg(F.count(F.lit(1)).alias("_value"))
    placed = df.withColumn("_word", F.when(F.col(key).isNotNull(), _place(F.col(key), COUNTED_PLACES)))
    return _looked_up(placed, words, "left").withColumnRenamed("_value", name).drop("_word")


def lookup_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table of lines with a table derived from few distinct values.

    The lookup is stored first, so that its true size decides: small ones are broadcast and the lines stay
    where they are.  A large one is shuffled, and adaptive execution splits the hot keys of the lines.
    """
    stored = materialize(lookup)
    return big.join(F.broadcast(stored) if is_small(stored) else stored, list(keys), how)


def over_distinct(df: DataFrame, column: str, **new: Column) -> DataFrame:
    """Add columns computed once per distinct value of ``column``, which must not be null."""
    values = df.select(column).distinct()
    return lookup_join(df, values.select(column, *(c.alias(n) for n, c in new.items())), [column])
