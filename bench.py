"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logmill import registry  # noqa: E402
from logmill.plans.parse import parse_batch  # noqa: E402
from logmill.registry import files, parsing  # noqa: E402
from logmill.session import local_session, scratch_path  # noqa: E402
from logmill.sources import raw  # noqa: E402

HEADLINE = [
    "match_dictionary",
    "correct_template_metric",
    "evaluate_all",
    "stratified_sample",
    "parse_batch",
    "read_raw_log",
    "grouping_accuracy",
    "template_accuracy",
    "parsing_accuracy",
    "match_tokens",
    "align_nulls",
    "template_catalog",
    "coarse_fine_clusters",
    "jaccard_distance",
    "min_distance",
    "adaptive_sample",
]
# tables whose rows a query works through, for the rows-per-second figures
ROWS = {
    "match_dictionary": ("events", "orders"),
    "evaluate_all": ("events",),
    "parse_batch": ("events", "orders"),
    "read_raw_log": ("events",),
}


def _raw_reader(spark, sf_dir):
    """The raw log is written before the clock starts."""
    path = scratch_path(spark, "bench-raw")
    files._write_raw(spark, sf_dir, path)
    return lambda: raw.read_raw_log(spark, path, "Apache")


def _parser(spark, sf_dir):
    """The model is fitted before the clock starts."""
    model = parsing._model(spark, sf_dir)
    return lambda: parse_batch(parsing._logs(spark, sf_dir), model).lines


PREPARED = {"read_raw_log": _raw_reader, "parse_batch": _parser}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    run(queries["parsing_accuracy"](spark, sf_dir))  # warm-up
    times, rates, prepared = {}, {}, {}
    for name in names:
        start = time.perf_counter()
        if name in PREPARED:
            query = PREPARED[name](spark, sf_dir)
            prepared[name] = round(time.perf_counter() - start, 3)
            start = time.perf_counter()
            run(query())
        else:
            run(queries[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
        if name in ROWS:
            rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ROWS[name])
            rates[name] = round(rows / times[name])
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "preparation": prepared,
                "total_with_preparation": round(sum(times.values()) + sum(prepared.values()), 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
