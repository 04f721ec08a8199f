"""Template correction as one parameterised chain of regex replacements.

The rules work on whole tokens.  Look-around marks the token borders, so no token arrays are built and the
whole chain stays in codegen.  Repeated groups are possessive: Java then loops over them instead of recursing,
so that texts of any length are safe.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .patterns import (
    BOOLEAN_WORDS,
    DEFAULT_WORDS,
    DIGIT,
    PATH_DELIMITERS,
    TOKEN_DELIMITERS,
    WILDCARD,
    chars,
    quote,
    whole_token,
    wild_piece,
)
from .text import normalize_ws

_PATH = chars(PATH_DELIMITERS) + " "
_TOKEN = chars(TOKEN_DELIMITERS) + " "


def _chain(separators: str) -> tuple[str, str]:
    """Merge of wildcards that stand next to each other or one of ``separators`` apart."""
    between = f"[{chars(separators)}]?" if len(separators) > 1 else quote(separators)
    return rf"<\*>(?:{between}<\*>)++", WILDCARD


def _framed(left: str, right: str) -> tuple[str, str]:
    """Unwrap a wildcard standing between spaces; neighbours may share the space."""
    return rf" {quote(left)}<\*>{quote(right)}(?= )", f" {WILDCARD}"


_DOTTED = _chain(".")
_ADJACENT = _chain("")
_PARSE_MERGES = (_DOTTED, _chain(": "))
_LEGACY_MERGES = (_DOTTED, _ADJACENT, _chain(":"), _chain(","))
_ORACLE_MERGES = (_DOTTED, _ADJACENT)
_METRIC_MERGES = (
    _DOTTED,
    _ADJACENT,
    _framed("#", "#"),
    _framed("#", ""),
    *(_chain(sep) for sep in ":#/@."),
    _framed('"', '"'),
    _framed("'", "'"),
    _ADJACENT,
    _chain(" "),
)


def correct_template(
    col: Column,
    *,
    merges: Sequence[tuple[str, str]],
    constants: Iterable[str] = (),
    ignore_case: bool = False,
    paths: bool = False,
) -> Column:
    """Squeeze blanks, then blank out paths, constants, digits and words with a wildcard, then merge."""
    text = normalize_ws(col)
    if paths:
        text = F.regexp_replace(text, whole_token(f"(?:/[^/{_PATH}]+)++", _PATH), WILDCARD)
    constants = sorted({c.lower() for c in constants})
    if constants:
        flag = "iu" if ignore_case else ""
        text = F.regexp_replace(text, whole_token(f"(?{flag}:{'|'.join(quote(c) for c in constants)})", _TOKEN), WILDCARD)
    # a digit is looked for first, and only then at what stands before it
    text = F.regexp_replace(text, f"{DIGIT}(?<![^{_TOKEN}]{DIGIT}){DIGIT}*+(?![^{_TOKEN}])", WILDCARD)
    wild = whole_token(wild_piece(f"/{_TOKEN}"), _TOKEN)
    # the rest is about wildcards
    return let(
        lambda t: F.when(F.contains(t, F.lit(WILDCARD)), _merged(F.regexp_replace(t, wild, WILDCARD), merges)).otherwise(t), text
    )


def _merged(text: Column, merges: Sequence[tuple[str, str]]) -> Column:
    """Apply ``merges`` in turn to texts that have a place for any of them; before the first one changes a text, the others see it as it is."""

    def applied(text: Column) -> Column:
        for pattern, replacement in merges:
            text = F.regexp_replace(text, pattern, replacement)
        return text

    places = "|".join(dict.fromkeys(pattern for pattern, _ in merges))
    return let(lambda t: F.when(F.rlike(t, F.lit(places)), applied(t)).otherwise(t), text)


def correct_template_parse(col: Column, user_strings: Iterable[str] = ()) -> Column:
    """The form used while parsing; constants are compared case-sensitively."""
    return correct_template(
        col,
        merges=_PARSE_MERGES,
        constants=(*BOOLEAN_WORDS, *DEFAULT_WORDS, *user_strings),
        paths=True,
    )


def correct_template_legacy(col: Column, user_strings: Iterable[str] = ()) -> Column:
    """Older form: constants in any case, wildcards merged when adjacent, then over ``:`` and ``,``."""
    return correct_template(
        col,
        merges=_LEGACY_MERGES,
        constants=(*BOOLEAN_WORDS, *DEFAULT_WORDS, *user_strings),
        ignore_case=True,
        paths=True,
    )


def correct_template_oracle(col: Column, user_strings: Iterable[str] = ()) -> Column:
    """The form for ground-truth files: constants in any case, only dotted and adjacent merges."""
    return correct_template(
        col,
        merges=_ORACLE_MERGES,
        constants=(*BOOLEAN_WORDS, *DEFAULT_WORDS, *user_strings),
        ignore_case=True,
        paths=True,
    )


def correct_template_metric(col: Column) -> Column:
    """The form applied to both sides before scoring."""
    return correct_template(col, merges=_METRIC_MERGES)


def merge_wildcards(col: Column) -> Column:
    """Only the merges of the parsing form."""
    for pattern, replacement in _PARSE_MERGES:
        col = F.regexp_replace(col, pattern, replacement)
    return col
