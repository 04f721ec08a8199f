"""The linear header guard against the lazy regex of each format."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logmill.catalog.formats import LOG_FORMATS, compile_format, linear_guard
from logmill.sources import raw


def glue_lines(fmt, rng, n):
    """Lines made of the pieces of a format, with blanks doubled, dropped and added."""
    pieces = re.findall(r"<[^<>]+>|\\.| +|.", fmt)
    for _ in range(n):
        line = ""
        for piece in pieces:
            kind = rng.random()
            if piece.startswith("<"):
                line += rng.choice(["", "a", "b c", "x:", "[9]", "a  b"])
            elif kind < 0.08:
                continue
            elif piece.startswith(" "):
                line += rng.choice([" ", "  ", piece, "\t"])
            elif piece not in "()?":
                line += piece[-1] + (" " if kind > 0.95 else "")
        yield line


@pytest.mark.parametrize("system", sorted(LOG_FORMATS))
def test_guard_decides_like_the_lazy_regex(system):
    fmt = LOG_FORMATS[system]
    guard = linear_guard(fmt)
    assert guard is not None
    lazy, quick = re.compile(compile_format(fmt).regex, re.ASCII), re.compile(guard, re.ASCII)
    rng = random.Random(system)
    found = [0, 0]
    for line in glue_lines(fmt, rng, 1500):
        expected = bool(lazy.search(line))
        assert bool(quick.search(line)) == expected, line
        found[expected] += 1
    assert min(found) > 2


def test_free_formats_have_no_guard():
    assert linear_guard(r"<A> (x|y) <B>") is None
    assert linear_guard(r"<A>\d+.<B>") is None
    assert linear_guard(r"no header") is None


def test_long_junk_lines_are_quick(spark):
    junk = " ".join(["word"] * 5000)
    df = spark.createDataFrame([(junk,), ("a b c d e: f",), ("a b c d e: f\ng",)], "value string")
    start = time.perf_counter()
    assert [r.Content for r in raw.header_parse(df, "HDFS").collect()] == ["f"]
    assert time.perf_counter() - start < 10


def test_line_numbers_after_limit(spark, tmp_path, monkeypatch):
    """The numbers stay right when the lines are shuffled on the way."""
    monkeypatch.setattr(raw, "MAX_SPLITS", -1)
    path = tmp_path / "app.log"
    path.write_text("".join(f"[t{k}] [info] line {k}\n" if k % 3 else f"junk {k}\n" for k in range(3000)))
    rows = raw.read_raw_log(spark, str(path), "Apache", limit=1000).orderBy("LineId").collect()
    assert [r.Content for r in rows] == [f"line {k}" for k in range(1000) if k % 3]
    assert [r.LineId for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("system", sorted(LOG_FORMATS))
def test_first_try_has_the_groups_of_the_lazy_regex(system):
    fmt = compile_format(LOG_FORMATS[system])
    lazy, first = re.compile(fmt.regex, re.ASCII), re.compile(fmt.first, re.ASCII)
    tried = 0
    for line in glue_lines(LOG_FORMATS[system], random.Random(system), 1500):
        if found := first.search(line):
            assert found.groups() == lazy.search(line).groups(), line
            tried += 1
    assert tried > 2


def test_headers_and_counts_are_those_of_the_lazy_regex(spark):
    from pyspark.sql import Observation

    for system in ("HDFS", "Linux", "Mac", "Apache"):
        fmt = compile_format(LOG_FORMATS[system])
        lines = list(glue_lines(LOG_FORMATS[system], random.Random(system), 300))
        lines = [None, "", *lines, *(x + "\x01y" for x in lines[:30]), *(f"\x02{x}" for x in lines[:30]), *(x + "\ny" for x in lines[:30]), *(f"  {x}\n" for x in lines[:30])]
        df = spark.createDataFrame(list(enumerate(lines)), "id long, value string")
        seen = Observation()
        found = {r.id: tuple(r[h.name] for h in fmt.headers) for r in raw.header_parse(df, system, observed=seen).collect()}
        assert found == {r.id: tuple(r[h.name] for h in fmt.headers) for r in raw.header_parse(df, system).collect()}
        lazy = re.compile(fmt.regex, re.ASCII)
        expected = {}
        for k, line in enumerate(lines):
            match = lazy.search(line.strip(raw._BLANKS)) if line is not None else None
            if match:
                expected[k] = tuple(match[h.group] or "" if not h.optional or match[h.optional] else None for h in fmt.headers)
        assert found == expected
        assert seen.get == {"n_lines": len(lines), "n_dropped": sum(x is not None for x in lines) - len(expected)}


def test_lines_are_matched_once(spark):
    df = spark.createDataFrame([("a b c d e: f",)], "value string")
    plan = raw.header_parse(df.withColumn("value", F.concat("value", F.lit("!"))), "HDFS")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(compile_format(LOG_FORMATS["HDFS"]).first) == 1 and plan.count("concat(value") == 1
