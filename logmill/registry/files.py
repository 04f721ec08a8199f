"""Readers and writers: the fixtures are written to the shared scratch folder and read back."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..catalog.formats import LOG_FORMATS, compile_format, format_catalog
from ..operators import sampling
from ..plans import evaluate, fixtures
from ..plans.parse import template_catalog
from ..session import scratch_path
from ..sources import raw, tables
from ..streaming.online import read_raw_log_stream
from . import sql
from .core import query

_STRUCTURED = """SELECT CAST("LineId" AS VARCHAR) AS "LineId", "Level", "Component", "Content", "EventId", "EventTemplate"
  FROM event_log"""
_PARSED = """SELECT row_number() OVER (ORDER BY event_id) AS "LineId", substr(CAST(ts AS VARCHAR), 1, 19) AS "Time",
  "Level", "Content" FROM event_log WHERE event_id % 50 <> 0"""


def _write_raw(spark, sf_dir, path):
    lines = fixtures.event_raw(spark, sf_dir).orderBy("event_id").select("line")
    lines.write.text(path)


@query("read_structured", sql.on_events(_STRUCTURED))
def read_structured(spark, sf_dir):
    path = scratch_path(spark, "structured")
    tables.write_structured(fixtures.event_log(spark, sf_dir), path)
    return tables.read_structured(spark, path)


@query(
    "write_structured",
    sql.on_docs('SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos AS VARCHAR) AS pos, "Content" FROM doc_lines'),
)
def write_structured(spark, sf_dir):
    """Document lines hold quotes, commas and signs of all sorts."""
    path = scratch_path(spark, "documents")
    tables.write_structured(fixtures.doc_lines(spark, sf_dir), path)
    return tables.read_structured(spark, path)


@query(
    "write_templates",
    sql.on_events(
        """SELECT 'E' || row_number() OVER (ORDER BY count(*) DESC, min("LineId")) AS "EventID",
        "EventTemplate", count(*) AS "Occurrence" FROM event_log GROUP BY "EventTemplate\""""
    ),
)
def write_templates(spark, sf_dir):
    path = scratch_path(spark, "templates")
    tables.write_templates(template_catalog(fixtures.event_log(spark, sf_dir)), path, "parquet")
    return spark.read.parquet(path)


@query("read_raw_log", sql.on_events(_PARSED))
def read_raw_log(spark, sf_dir):
    path = scratch_path(spark, "raw")
    _write_raw(spark, sf_dir, path)
    return raw.read_raw_log(spark, path, "Apache")


@query(
    "read_raw_log_head",
    sql.on_events(_PARSED + " AND event_id < (SELECT min(event_id) + 700 FROM events)"),
)
def read_raw_log_head(spark, sf_dir):
    """The first 700 lines of the file, of which the malformed ones get no number."""
    path = scratch_path(spark, "raw")
    _write_raw(spark, sf_dir, path)
    return raw.read_raw_log(spark, path, "Apache", limit=700)


@query(
    "header_parse",
    sql.on_events(
        """SELECT event_id, substr(CAST(ts AS VARCHAR), 1, 19) AS "Time", "Level", "Content"
        FROM event_log WHERE event_id % 50 <> 0"""
    ),
)
def header_parse(spark, sf_dir):
    return raw.header_parse(fixtures.event_raw(spark, sf_dir), "Apache", "line")


@query(
    "drop_unmatched",
    sql.on_events(
        """SELECT count(*) AS n_lines, count(*) FILTER (line NOT LIKE '[%] [%] %') AS n_dropped FROM event_raw"""
    ),
)
def drop_unmatched(spark, sf_dir):
    return raw.unmatched_count(fixtures.event_raw(spark, sf_dir), "Apache", "line")


# One line per event and system; a header's value is its place in the line, the content is the event's.
_SYSTEMS = ", ".join(
    f"('{name}', {len(compile_format(fmt).names)})" for name, fmt in LOG_FORMATS.items()
)


def _rendered(fmt: str, optional: bool) -> list:
    """The format as a list of column parts that write a line."""
    parts, names = [], compile_format(fmt).names
    text = fmt.replace(r"(\[<PID>\])?", "[<PID>]" if optional else "").replace(
        r"( \(<Address>\))?", " (<Address>)" if optional else ""
    ).replace("\\", "")
    while text:
        start = text.find("<")
        if start < 0:
            parts.append(F.lit(text))
            break
        end = text.index(">", start)
        name = text[start + 1 : end]
        if start:
            parts.append(F.lit(text[:start]))
        value = F.col("Content") if name == "Content" else F.concat(
            F.lit(f"v{names.index(name)}-"), F.col("event_id")
        )
        parts.append(value)
        text = text[end + 1 :]
    return parts


@query(
    "header_parse_all_formats",
    sql.on_events(
        f"""SELECT system, event_id, n_headers,
          CASE WHEN event_id % 2 = 1 AND system IN ('Thunderbird', 'Linux', 'Mac') THEN n_headers - 2 ELSE n_headers - 1 END AS n_right,
          "Content" FROM event_log, (VALUES {_SYSTEMS}) s(system, n_headers)"""
    ),
)
def header_parse_all_formats(spark, sf_dir):
    """Every event written and parsed in every known format; odd ones leave the optional header out."""
    events = fixtures.event_log(spark, sf_dir).select(
        (F.col("LineId") - 1).alias("event_id"), "Content"
    )
    results = []
    for system, fmt in LOG_FORMATS.items():
        line = F.when(
            F.col("event_id") % 2 == 1, F.concat(*_rendered(fmt, False))
        ).otherwise(F.concat(*_rendered(fmt, True)))
        parsed = raw.header_parse(events.select("event_id", line.alias("value")), system)
        names = compile_format(fmt).names
        right = functools.reduce(
            lambda a, b: a + b,
            (
                F.coalesce(
                    (F.col(n) == F.concat(F.lit(f"v{i}-"), F.col("event_id"))).cast("int"), F.lit(0)
                )
                for i, n in enumerate(names)
                if n != "Content"
            ),
        )
        results.append(
            parsed.select(
                F.lit(system).alias("system"),
                "event_id",
                F.lit(len(names)).alias("n_headers"),
                right.alias("n_right"),
                "Content",
            )
        )
    return functools.reduce(lambda a, b: a.unionByName(b), results)


@query(
    "format_catalog",
    sql.on_events(
        f"""SELECT system, n_headers, system || '/' || system || '_{{}}.log' AS log_file, count("LineId") AS n_lines
        FROM (VALUES {_SYSTEMS}) s(system, n_headers)
        LEFT JOIN event_log ON system = 'Apache' AND event_id % 50 <> 0 GROUP BY system, n_headers"""
    ),
)
def catalog_with_lines(spark, sf_dir):
    """The known systems with the number of fixture lines that each one's format reads."""
    lines = raw.header_parse(fixtures.event_raw(spark, sf_dir), "Apache", "line").select(
        F.lit("Apache").alias("system"), "Content"
    )
    counts = lines.groupBy("system").agg(F.count(F.lit(1)).alias("n_lines"))
    return format_catalog(spark).join(counts, "system", "left").select(
        "system", F.size("headers").alias("n_headers"), "log_file", F.coalesce("n_lines", F.lit(0)).alias("n_lines")
    )


@query(
    "read_samples",
    sql.on_events(
        """SELECT "Content" AS log, "EventTemplate" AS template,
        CASE "LineId" % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'dev' END AS split FROM event_log"""
    ),
)
def read_samples(spark, sf_dir):
    rows = fixtures.event_log(spark, sf_dir)
    paths = [scratch_path(spark, f"samples{r}") for r in range(3)]
    for r, path in enumerate(paths):
        part = rows.where(F.col("LineId") % 3 == r)
        part.select(F.col("Content").alias("log"), F.col("EventTemplate").alias("template")).write.json(path)
    return tables.read_samples(spark, *paths)


@query(
    "write_samples",
    sql.on_events(
        """SELECT shot, log, template FROM (
          SELECT "Content" AS log, "EventTemplate" AS template,
            row_number() OVER (ORDER BY md5('3|' || "Content" || '|' || "EventTemplate"), "Content") AS r
          FROM (SELECT DISTINCT "Content", "EventTemplate" FROM event_log)), (VALUES (8), (16)) s(shot) WHERE r <= shot"""
    ),
)
def write_samples(spark, sf_dir):
    """Random samples of two sizes, one folder each, read back."""
    rows = fixtures.event_log(spark, sf_dir).select(
        F.col("Content").alias("log"), F.col("EventTemplate").alias("label"),
        F.lit("").alias("coarse"), F.lit("").alias("fine"),
    ).distinct()
    samples = sampling.round_robin_sample(rows, [8, 16], seed=3)
    path = scratch_path(spark, "shots")
    tables.write_samples(samples.withColumnRenamed("label", "template"), path)
    return spark.read.json(path, schema="log string, template string, shot int")


@query(
    "append_summary",
    sql.on_events(
        """SELECT "Component" AS "Dataset", round(avg((gt = pred)::INT), 3) AS "PA", count(*) AS n_appended FROM (
          SELECT * FROM pairs UNION ALL SELECT * FROM pairs) GROUP BY "Component\""""
        .replace("count(*) AS n_appended", "2 AS n_appended")
    ),
)
def append_summary(spark, sf_dir):
    """Two runs append their rows to one summary."""
    pairs = fixtures.pairs(spark, sf_dir).withColumnRenamed("Component", "Dataset")
    from ..operators.metrics import score

    path = scratch_path(spark, "summary")
    row = evaluate.summary_row(score(pairs, by=["Dataset"]))
    tables.append_summary(row, path)
    tables.append_summary(row, path)
    return spark.read.parquet(path).groupBy("Dataset", "PA").agg(
        F.count(F.lit(1)).cast("int").alias("n_appended")
    )


@query(
    "upsert_time_cost",
    """SELECT event_type AS "Dataset", count(*) AS "TrainingTime",
      CASE WHEN event_type IN ('view', 'click') THEN 2 ELSE 1 END AS "ParsingTime" FROM events GROUP BY event_type""",
)
def upsert_time_cost(spark, sf_dir):
    """All records are written, then those of two datasets again with another value."""
    path = scratch_path(spark, "times")
    events = fixtures.table(spark, sf_dir, "events").withColumnRenamed("event_type", "Dataset")
    times = events.groupBy("Dataset").agg(F.count(F.lit(1)).alias("TrainingTime"))
    tables.upsert_time_cost(times.withColumn("ParsingTime", F.lit(1)), path)
    again = times.where(F.col("Dataset").isin("view", "click"))
    tables.upsert_time_cost(again.withColumn("ParsingTime", F.lit(2)), path)
    return spark.read.parquet(path)


@query("save_run_config", """SELECT '{"lines": ' || count(*) || ', "shots": [32]}' AS value FROM events""")
def save_run_config(spark, sf_dir):
    """The settings of the first run stay when a second one has others."""
    path = scratch_path(spark, "config")
    lines = fixtures.table(spark, sf_dir, "events").count()
    tables.save_run_config(spark, {"shots": [32], "lines": lines}, path)
    tables.save_run_config(spark, {"shots": [8], "lines": 0}, path)
    return spark.read.text(path)


@query("load_dataset_csv", sql.on_events(_STRUCTURED))
def load_dataset_csv(spark, sf_dir):
    base = scratch_path(spark, "datasets")
    tables.write_structured(
        fixtures.event_log(spark, sf_dir), f"{base}/Apache/Apache_full.log_structured.csv"
    )
    return tables.load_dataset(spark, base, "Apache")


@query("load_dataset_text", sql.on_events(_PARSED))
def load_dataset_text(spark, sf_dir):
    base = scratch_path(spark, "datasets")
    _write_raw(spark, sf_dir, f"{base}/Apache/Apache_full.log")
    return tables.load_dataset(spark, base, "Apache", format="text")


@query(
    "read_raw_log_stream",
    sql.on_events(
        """SELECT substr(CAST(ts AS VARCHAR), 1, 19) AS "Time", "Level", "Content" FROM event_log WHERE event_id % 50 <> 0"""
    ),
)
def raw_log_stream(spark, sf_dir):
    """The raw lines as files that a stream picks up one after the other."""
    source, out, state = (scratch_path(spark, n) for n in ("incoming", "parsed", "progress"))
    lines = fixtures.event_raw(spark, sf_dir).select("line")
    lines.repartitionByRange(3, "line").write.text(source)
    stream = read_raw_log_stream(spark, source, "Apache", files_per_batch=1)
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    return spark.read.parquet(out)
