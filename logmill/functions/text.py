"""Whitespace, tokenisers and cleaning, each one chain of built-in string functions.

The tokenisers yield words without blanks, so a token list has an exact text form: the tokens joined by
one space.  The text form stays inside whole-stage codegen; arrays are cut from it only where needed.
White space is squeezed first, so that all later patterns deal with the plain space only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import (
    CLEANED_CHARACTERS,
    DIGIT,
    MATCH_DELIMITERS,
    MATCH_KEPT,
    SIMILARITY_KEPT,
    SPACES,
    TAGGER_DELIMITERS,
    WILDCARD,
    chars,
    wild_piece,
)

_DELIMS = chars(MATCH_DELIMITERS) + " "
# A run of non-delimiters that holds a wildcard; the look-behind starts it at run starts only.
_WILD_RUN = f"(?<![^{_DELIMS}]){wild_piece(_DELIMS)}"


def _blanked(col: Column, more: str = "") -> Column:
    """Trim, and squeeze every run of white space, and of the characters ``more`` (a class body), to one space."""
    return F.trim(F.regexp_replace(col, f"[{more}{SPACES}]+", " "))


def normalize_ws(col: Column) -> Column:
    """Trim, and squeeze every run of white space to one space."""
    return _blanked(col)


def words(col: Column) -> Column:
    """Words between white space, as an array without empty entries."""
    return F.array_remove(F.split(normalize_ws(col), " "), "")


def is_valid_template(col: Column) -> Column:
    """True if anything but wildcards, spaces and ASCII punctuation is left."""
    rest = F.replace(F.replace(col, F.lit(WILDCARD), F.lit("")), F.lit(" "), F.lit(""))
    return F.rlike(rest, F.lit(r"[^!-/:-@\[-`{-~]"))


def _joined(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"<\*>(?: +<\*>)++", WILDCARD))


def match_text(col: Column) -> Column:
    """Matching tokens of a line or template, joined by one space.

    Every delimiter splits; ``= | ( ) ;`` stay as tokens, other delimiters vanish; a piece that holds a
    wildcard becomes the wildcard, and neighbouring wildcards merge.
    """
    text = F.regexp_replace(normalize_ws(col), _WILD_RUN, WILDCARD)
    text = F.regexp_replace(text, f"[{chars(MATCH_KEPT)}]", r" $0 ")
    text = F.regexp_replace(text, f"[{chars(MATCH_DELIMITERS, without=MATCH_KEPT)} ]+", " ")
    return _joined(text)


def split_text(text: Column) -> Column:
    """Token array of a text form; the empty text has no tokens."""
    return F.array_remove(F.split(text, " "), "")


def match_tokens(col: Column) -> Column:
    return split_text(match_text(col))


def similarity_text(col: Column) -> Column:
    """Like :func:`match_text`, but runs of delimiters form one piece and ``;`` vanishes too."""
    kept = chars(SIMILARITY_KEPT)
    dropped = chars(MATCH_DELIMITERS, without=SIMILARITY_KEPT) + " "
    text = F.regexp_replace(normalize_ws(col), _WILD_RUN, WILDCARD)
    text = F.regexp_replace(text, f"(?<=[{kept}])[{dropped}]+|[{dropped}]++(?=[{kept}])", "")
    text = F.regexp_replace(text, f"[{kept}]+", r" $0 ")
    text = F.regexp_replace(text, f"[{dropped}]+", " ")
    return _joined(text)


def similarity_tokens(col: Column) -> Column:
    return split_text(similarity_text(col))


def tagger_pieces(col: Column) -> Column:
    """Tagger tokens as strings; a leading space marks a token that follows a space."""
    inner = chars(TAGGER_DELIMITERS, without=" ")
    piece = f"( ?(?:[{inner}]|[^{chars(TAGGER_DELIMITERS)}]+))"
    return F.regexp_extract_all(col, F.lit(piece), F.lit(1))


def _as_tokens(pieces: Column) -> Column:
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.ltrim(p).alias("token"),
            F.startswith(p, F.lit(" ")).alias("space_before"),
        ),
    )


def tagger_tokens(col: Column) -> Column:
    """Tagger tokens as ``array<struct<token, space_before>>``."""
    return _as_tokens(tagger_pieces(col))


def fine_pieces(col: Column) -> Column:
    """Runs of letters and digits, and single signs; a leading space marks one that follows a space."""
    piece = rf"( ?(?:[\p{{L}}{DIGIT}]+|[^\p{{L}}{DIGIT} ]))"
    return F.regexp_extract_all(col, F.lit(piece), F.lit(1))


def fine_tokens(col: Column) -> Column:
    """The tokens of :func:`tagger_tokens` cut by :func:`finer_tokens`, straight from the text."""
    return _as_tokens(fine_pieces(col))


def finer_tokens(tokens: Column) -> Column:
    """Cut tagger tokens (with any further fields) into runs of letters and digits, and single signs."""

    def parts(t: Column) -> Column:
        pieces = F.regexp_extract_all(
            t["token"], F.lit(rf"([\p{{L}}{DIGIT}]+|[^\p{{L}}{DIGIT}])"), F.lit(1)
        )
        return F.transform(
            pieces,
            lambda p, i: t.withField("token", p).withField(
                "space_before", t["space_before"] & (i == 0)
            ),
        )

    return F.flatten(F.transform(tokens, parts))


def clean(col: Column) -> Column:
    """Blank out punctuation and drop the words that hold a digit."""
    text = F.replace(col, F.lit(".!"), F.lit(" "))
    text = _blanked(text, f"{chars(CLEANED_CHARACTERS)}!")
    text = F.regexp_replace(text, rf"(?<![^ ])[^ {DIGIT}]*+{DIGIT}[^ ]*+ ?", "")
    return F.rtrim(text)


def char_signature(col: Column) -> Column:
    """Sorted distinct characters left after deleting ASCII letters, digits, commas and spaces."""
    rest = F.regexp_replace(col, "[0-9A-Za-z, ]+", "")
    return F.array_join(F.array_sort(F.array_distinct(F.split(rest, ""))), "")


def loose_equal(a: Column, b: Column) -> Column:
    """Compare by single-space pieces, where a piece of ``a`` holding a wildcard counts as the wildcard."""
    loosened = F.regexp_replace(a, r"(?<![^ ])[^ ]*<\*>[^ ]*", WILDCARD)
    return loosened == b
