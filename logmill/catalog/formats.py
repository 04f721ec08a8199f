"""Log formats of known systems, and their translation to one numbered-group regex."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Line formats.  <Name> is a header, the rest is regex glue.
LOG_FORMATS = {
    "HDFS": r"<Date> <Time> <Pid> <Level> <Component>: <Content>",
    "Hadoop": r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>",
    "Spark": r"<Date> <Time> <Level> <Component>: <Content>",
    "Zookeeper": r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
    "BGL": r"<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>",
    "HPC": r"<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
    "Thunderbird": r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
    "Windows": r"<Date> <Time>, <Level>                  <Component>    <Content>",
    "Linux": r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
    "Android": r"<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
    "HealthApp": r"<Time>\|<Component>\|<Pid>\|<Content>",
    "Apache": r"\[<Time>\] \[<Level>\] <Content>",
    "Proxifier": r"\[<Time>\] <Program> - <Content>",
    "OpenSSH": r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
    "OpenStack": r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
    "Mac": r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>",
}


@dataclass(frozen=True)
class Header:
    name: str
    group: int
    #: group number of the optional part around the header, or 0
    optional: int


@dataclass(frozen=True)
class LineFormat:
    regex: str
    n_groups: int
    headers: tuple[Header, ...]
    #: A pattern for the same lines that never goes back; None where the format is too free for one.
    guard: str | None
    #: The regex without going back over a header and what follows it: where it matches, its groups are those of the
    #: regex, for they are the first that it tries.  None where there is no guard.
    first: str | None

    @property
    def names(self) -> list[str]:
        return [h.name for h in self.headers]


def compile_format(log_format: str) -> LineFormat:
    """Turn a format into a regex with numbered groups; runs of blanks match any white space."""
    regex, first, headers, open_groups, n_groups = "^", "^", [], [], 0
    is_open = False
    for name, escaped, blanks, other in re.findall(r"<([^<>]+)>|(\\.)|( +)|(.)", log_format):
        if name:
            n_groups += 1
            headers.append(Header(name, n_groups, open_groups[-1] if open_groups else 0))
            if not open_groups:
                first += ")" * is_open + "(?>"
                is_open = True
            piece = "(.*?)"
        elif blanks:
            piece = r"\s+"
        else:
            if other == "(":
                n_groups += 1
                open_groups.append(n_groups)
            elif other == ")":
                open_groups.pop()
            piece = escaped or other
        regex += piece
        first += piece
    # the last header runs as far as what follows it demands, or to the end
    last = first.rfind("(?>")
    first = first[:last] + first[last + 3 :] if is_open else first
    if is_open and first.endswith("(.*?)"):
        first = first[:-2] + ")"
    guard = linear_guard(log_format)
    return LineFormat(regex + "$", n_groups, tuple(headers), guard, None if guard is None else first + "$")


_HEADER = "<>"


def _items(log_format: str) -> list[str] | None:
    """Headers, blanks, literal characters and optional parts (``(?:…)?``); None if there is other regex syntax."""
    items, inside = [], None
    for name, escaped, blanks, other in re.findall(r"<([^<>]+)>|(\\.)|( +)|(.)", log_format):
        if other == "(" and inside is None:
            inside = ""
        elif other == ")" and inside is not None:
            items.append(f"(?:{inside})")
            inside = None
        elif other == "?" and items and items[-1].startswith("(?:"):
            items[-1] += "?"
        elif other and other in "()[]{}*+?|^$.":
            return None
        elif inside is not None:
            inside += ".*?" if name else r"\s+" if blanks else escaped or other
        else:
            items.append(_HEADER if name else " " if blanks else escaped or other)
    groups = [item for item in items if item.startswith("(?:")]
    return None if inside is not None or any(not g.endswith("?") for g in groups) else items


def linear_guard(log_format: str) -> str | None:
    """A pattern that decides in linear time whether a format's lazy regex matches a line without line feeds.

    Headers may hold anything, so the earliest place and the shortest form of the glue behind a header leave the
    most room for the rest: each header with its glue is one atomic group, and a blank next to a header is one
    blank.  An optional part right behind a header is left out, for the header can hold it; elsewhere one is kept if
    only the last header follows.  None where the format is too free for this.
    """
    items = _items(log_format)
    if items is None:
        return None
    items = [x for k, x in enumerate(items) if not (x.startswith("(?:") and k and items[k - 1] == _HEADER)]
    last = len(items) - 1 - items[::-1].index(_HEADER) if _HEADER in items else None
    if last is None or any(x.startswith("(?:") and items[k:].count(_HEADER) != 1 for k, x in enumerate(items)):
        return None
    pattern, is_open = "^", False
    for k, item in enumerate(items):
        if item == _HEADER:
            pattern += ")" * is_open + (".*?" if k == last else "(?>.*?")
            is_open = k != last
        elif item == " ":
            beside = (k and items[k - 1] == _HEADER) or items[k + 1 : k + 2] == [_HEADER]
            pattern += r"\s" if beside else r"\s+"
        else:
            pattern += item
    return pattern + "$"


def format_catalog(spark: SparkSession) -> DataFrame:
    """The known systems as rows: system, log_file pattern, log_format, headers."""
    rows = [
        (name, f"{name}/{name}_{{}}.log", fmt, compile_format(fmt).names)
        for name, fmt in LOG_FORMATS.items()
    ]
    return spark.createDataFrame(
        rows, "system string, log_file string, log_format string, headers array<string>"
    )


def missing_result_rows(expected: DataFrame, metrics: DataFrame, key: str = "Dataset") -> DataFrame:
    """One summary row per expected dataset; the metrics are null where no prediction exists."""
    return expected.select(key).join(metrics, key, "left")


def file_name(system: str, version: str = "full") -> str:
    return f"{system}/{system}_{version}.log"


def known_systems(spark: SparkSession) -> DataFrame:
    return format_catalog(spark).select(F.col("system").alias("Dataset"))
