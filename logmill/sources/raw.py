"""Raw text logs: header parsing and line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..catalog.formats import LOG_FORMATS, LineFormat, compile_format
from ..functions.align import captures, matches, packed_captures, unpacked_captures
from ..operators.scale import is_small, running_offsets, with_sequence
from ..session import materialize

#: More file splits than this are joined by shuffle; 100 TB in splits of 128 MB are 0.8 million.
MAX_SPLITS = 2_000_000
#: So many first lines of a log pass through the driver; more are numbered where they lie.
HEAD_ROWS = 100_000

# Characters that count as white space at the ends of a line.
_BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _format(fmt: str) -> LineFormat:
    return compile_format(LOG_FORMATS.get(fmt, fmt))


def _decodable(line: Column) -> Column:
    """Leave out bytes that are not UTF-8."""
    cleaned = F.replace(F.make_valid_utf8(line), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(line), line).otherwise(cleaned)


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _is_match(line: Column, fmt: LineFormat) -> Column:
    """Of a stripped line, decided without going back where the format allows it; a line feed is the one thing a header cannot hold."""
    exact = matches(line, F.lit(fmt.regex))
    if fmt.guard is None:
        return exact
    return F.when(F.contains(line, F.lit("\n")), exact).otherwise(matches(line, F.lit(fmt.guard)))


def _captured(line: Column, fmt: LineFormat) -> Column:
    """The list of a line's match, its groups; empty or NULL without one.

    Most lines match at the first try (``_first``).  Others are decided on by the guard before the regex goes back.
    """
    exact = F.when(_is_match(line, fmt), F.array(captures(line, F.lit(fmt.regex), F.lit(fmt.n_groups))))
    if fmt.first is None:
        return exact
    return F.coalesce(unpacked_captures(F.col("_first")), exact)


def _headers(groups: Column, fmt: LineFormat) -> list[Column]:
    def value(header):
        text = F.element_at(groups, header.group)
        if header.optional:
            text = F.when(F.element_at(groups, header.optional) != "", text)
        return text.alias(header.name)

    return [value(h) for h in fmt.headers]


def header_parse(df: DataFrame, fmt: str, column: str = "value", observed: str | Observation | None = None) -> DataFrame:
    """Split lines into header columns; lines that do not match are dropped.

    ``fmt`` is a known system or a format string.  Lines are decided on by a linear guard; those that pass are
    matched once for all headers.  ``observed`` counts lines and dropped lines as the result is computed, under that
    name in a stream, or into an :class:`Observation`.
    """
    line_format = _format(fmt)
    kept = [c for c in df.columns if c != column]
    lines = df.select(*kept, _stripped(F.col(column)).alias("_stripped"))
    line = F.col("_stripped")
    if not line_format.n_groups:
        passed = lines.withColumn("_groups", F.when(_is_match(line, line_format), F.array(F.array().cast("array<string>"))))
    else:
        # in steps, since an expression used twice is computed twice
        if line_format.first is not None:
            lines = lines.withColumn("_first", packed_captures(line, line_format.first, line_format.n_groups))
        passed = lines.withColumn("_groups", _captured(line, line_format))
    # a filter on the match itself, or on a list that may be empty, would be moved before the match and repeat it
    passed = passed.select(*kept, "_stripped", F.explode_outer("_groups").alias("_groups"))
    if observed is not None:
        dropped = F.col("_stripped").isNotNull() & F.col("_groups").isNull()
        passed = passed.observe(observed, F.count(F.lit(1)).alias("n_lines"), F.count_if(dropped).alias("n_dropped"))
    passed = passed.where("_groups IS NOT NULL")
    return passed.select(*kept, *_headers(F.col("_groups"), line_format))


def unmatched_count(df: DataFrame, fmt: str, column: str = "value") -> DataFrame:
    """How many lines there are, and how many :func:`header_parse` drops."""
    unmatched = ~_is_match(_stripped(F.col(column)), _format(fmt))
    return df.agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(unmatched).alias("n_dropped")
    )


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the place of their file split."""
    return spark.read.text(path).select(
        _decodable(F.col("value")).alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def number_in_file_order(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a text scan 1..n in file order, without shuffling the lines.

    Ids rise inside a split, so a line's number is its distance from the first id of its split plus the
    sizes of all splits before it.  Only one row per split is aggregated, stored and joined back.
    """
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    splits = marked.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first")
    )
    offsets = materialize(running_offsets(splits, ["_file", "_block"]).drop("n"))
    few = is_small(offsets, MAX_SPLITS)
    numbered = marked.join(F.broadcast(offsets) if few else offsets, ["_file", "_block"])
    return numbered.select(
        (F.col("_offset") + F.col("_id") - F.col("_first") + 1).alias(name),
        *[c for c in df.columns],
    )


def read_raw_log(
    spark: SparkSession, path: str, fmt: str, limit: int | None = None, observed: Observation | None = None
) -> DataFrame:
    """Read a text log into LineId and header columns; only matching lines get a number.

    The lines are matched once: the parse is stored, and numbered from there.  ``limit`` reads the first lines of the log
    only.  ``observed`` gets the numbers of lines read and dropped.
    """
    if limit is not None:
        lines = first_lines(spark, path, limit).withColumn("_order", F.col("_line"))
        return with_sequence(header_parse(lines, fmt, observed=observed).drop("_line"), [F.col("_order")], "LineId").select(
            "LineId", *(h.name for h in _format(fmt).headers)
        )
    parsed = materialize(header_parse(read_text(spark, path), fmt, observed=observed))
    return number_in_file_order(parsed, "LineId").drop("_file", "_block")


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(_line, value) of the first ``n`` lines of a log of one or many files, in file order.

    Files are read in turn and no further than need be.  A few lines come from the first splits of a file, one by one;
    for more than HEAD_ROWS whole files are numbered, in groups that double until they hold enough.
    """
    files = sorted(spark.read.text(path).inputFiles())
    if n <= HEAD_ROWS:
        found: list[tuple[int, str]] = []
        for file in files:
            if len(found) >= n:
                break
            # the splits of one file are read in order, and later ones only if the first hold too few lines
            rows = spark.read.text(file).select(_decodable(F.col("value")).alias("value")).take(n - len(found))
            found += [(len(found) + k + 1, row.value) for k, row in enumerate(rows)]
        return spark.createDataFrame(found, "_line bigint, value string")
    read, size, lines = 0, 0, None
    while read < len(files) and size < n:
        group = files[read : 2 * read + 1]
        size += spark.read.text(group).limit(n - size).count()
        read += len(group)
    lines = number_in_file_order(read_text(spark, files[:read]), "_line")
    return lines.where(F.col("_line") <= n).select("_line", "value")


def limit_lines(df: DataFrame, n: int, order: str = "LineId") -> DataFrame:
    """The first ``n`` lines."""
    return df.orderBy(order).limit(n)


def head_fraction(df: DataFrame, fraction: float = 0.2, order: str = "LineId") -> DataFrame:
    """The first share of the lines, for line ids that run from 1 without gaps."""
    size = df.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("n")).scalar()
    return df.where(F.col(order) <= size)
