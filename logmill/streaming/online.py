"""Parsing files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dictionary import DICTIONARY_SCHEMA
from ..operators.tagging import TaggerModel
from ..plans.parse import parse_batch
from ..session import materialize
from ..sources.raw import header_parse

#: The name under which a stream reports its lines.
LINES = "lines"
#: Micro-batches between two whole dictionaries.
SNAPSHOT_EVERY = 16


def read_raw_log_stream(
    spark: SparkSession, directory: str, fmt: str, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of header columns over text files that arrive in a directory.

    Every batch reports its lines and those that its headers dropped; see :func:`dropped_lines`.
    """
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return header_parse(reader.text(directory), fmt, observed=LINES)


def dropped_lines(query: StreamingQuery) -> list[tuple[int, int, int]]:
    """(batch, lines, dropped lines) of the batches that the query still remembers, counted as they ran."""
    found = [(p.batchId, p.observedMetrics.get(LINES)) for p in query.recentProgress]
    return [(batch, row.n_lines, row.n_dropped) for batch, row in found if row is not None]


def _snapshot_before(version: int, every: int) -> int:
    """The last version up to this one of which the whole dictionary was written; -1 if none was."""
    return (version + 1) // every * every - 1


def dictionary_at(spark: SparkSession, state: str, version: int, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """The dictionary after a micro-batch: the last whole one, and what was new in the batches since, ``every`` at most."""
    whole = _snapshot_before(version, every)
    paths = [f"{state}/whole/version={whole}"] if whole >= 0 else []
    paths += [f"{state}/new/version={v}" for v in range(whole + 1, version + 1)]
    return spark.read.schema(DICTIONARY_SCHEMA).parquet(*paths)


def latest_version(spark: SparkSession, state: str) -> int:
    """The last micro-batch that added a template."""
    return spark.read.schema("version bigint").option("basePath", f"{state}/new").parquet(f"{state}/new").agg(F.max("version")).first()[0]


def _remove(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in map(hadoop, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parse_stream(
    stream: DataFrame,
    model: TaggerModel,
    state: str,
    output: str,
    checkpoint: str,
    column: str = "Content",
    initial: DataFrame | None = None,
    trigger: dict | None = None,
    every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Parse every micro-batch with the dictionary that the batches before it have grown.

    Batch *n* reads the dictionary up to version *n-1* and overwrites its own output and the templates that are new in
    version *n*, so a batch that runs again after a failure gives the same result.  All paths are on shared storage.
    ``trigger`` is passed to the stream, such as ``{"processingTime": "1 minute"}``; by default it takes what there
    is and ends.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # read, parsed and counted once
        batch = materialize(batch)
        known = initial if batch_id == 0 else dictionary_at(spark, state, batch_id - 1, every)
        parsed = parse_batch(batch, model, known, column)
        parsed.lines.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        new = parsed.dictionary
        if batch_id > 0:
            new = new.join(known.select("template_id"), "template_id", "left_anti")
        new = new.select("template_id", "template", "text").hint("rebalance")
        new.write.mode("overwrite").parquet(f"{state}/new/version={batch_id}")
        last = _snapshot_before(batch_id, every)
        if last == batch_id:
            before = dictionary_at(spark, state, batch_id - 1, every) if batch_id else new.where("false")
            whole = before.unionByName(spark.read.schema(DICTIONARY_SCHEMA).parquet(f"{state}/new/version={batch_id}"))
            whole.hint("rebalance").write.mode("overwrite").parquet(f"{state}/whole/version={batch_id}")
            gone = range(batch_id - 2 * every + 1, batch_id - every + 1)
            _remove(spark, [f"{state}/new/version={v}" for v in gone if v >= 0])
            if batch_id >= 2 * every:
                _remove(spark, [f"{state}/whole/version={batch_id - 2 * every}"])

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
