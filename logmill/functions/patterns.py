"""Fixed values shared by the text functions, and small regex helpers."""

from __future__ import annotations

WILDCARD = "<*>"
WILDCARD_RX = r"<\*>"

# Delimiter sets.
MATCH_DELIMITERS = "!\"#$%&'()+,-/;:=?@.[\\]^_`{|}~"
MATCH_KEPT = "=|();"
SIMILARITY_KEPT = "=|()"
TAGGER_DELIMITERS = " |()[]{}"
PATH_DELIMITERS = ",!;:=|\"'[](){}"
TOKEN_DELIMITERS = PATH_DELIMITERS + ".-+@#$%&"
CLEANED_CHARACTERS = ":()=,\"{}@[]|;"

# Words rewritten to a wildcard.
BOOLEAN_WORDS = ("true", "false")
DEFAULT_WORDS = ("null", "root", "admin")

# Words left out of the vocabulary (case-sensitive).
STOP_WORDS = ("a", "an", "and", "i", "ie", "so", "to", "the")
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)
VOCABULARY_STOP_WORDS = tuple(
    dict.fromkeys(
        STOP_WORDS
        + DAY_NAMES
        + tuple(d[:3] for d in DAY_NAMES)
        + MONTH_NAMES
        + tuple(m[:3] for m in MONTH_NAMES)
    )
)

# Unicode white space, for use inside a character class.  The Latin-1 ones are listed singly, which Java
# turns into a bit set; the others sit behind one range check.
SPACES = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
DIGIT = r"\p{Nd}"

_REGEX_SPECIAL = "\\^$.|?*+()[]{}&-"


def quote(text: str) -> str:
    """Escape ``text`` for a Java regex, inside or outside a character class."""
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in text)


def chars(text: str, *, without: str = "") -> str:
    """The body of a character class holding the characters of ``text``."""
    return "".join(quote(ch) for ch in text if ch not in without)


def whole_token(body: str, delimiters: str) -> str:
    """A regex for ``body`` where it fills a whole piece between ``delimiters`` (a class body)."""
    return f"(?<![^{delimiters}])(?:{body})(?![^{delimiters}])"


def wild_piece(excluded: str) -> str:
    """A regex for a run of characters outside ``excluded`` (a class body) that holds a wildcard.

    It never goes back over a run, so long words without a wildcard cost one pass.
    """
    run = f"[^{excluded}<]*+"
    return rf"{run}(?:<(?!\*>){run})*+<\*>[^{excluded}]*+"
