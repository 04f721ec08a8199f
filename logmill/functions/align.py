"""Regexes built from template columns, captured parameters, and token tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .patterns import WILDCARD, WILDCARD_RX
from .text import normalize_ws, tagger_pieces

# Captured groups travel through one replacement, cut apart again at SEP; MARK tells a match from no match.
_MARK, _SEP = "\u0002", "\u0001"
# Lines holding these take the slower group-by-group way.
_AMBIGUOUS = "[\u0001\u0002\n]"


def escape_regex(col: Column) -> Column:
    """Escape regex metacharacters; a wildcard becomes the text ``<\\*>``."""
    return F.regexp_replace(col, r"[\\^$.|?*+()\[\]{}]", r"\\$0")


def _anchored(body: Column) -> Column:
    return F.concat(F.lit("^"), body, F.lit("$"))


def _wild_as(body: Column, group: str) -> Column:
    return F.replace(body, F.lit(WILDCARD_RX), F.lit(group))


def wildcard_count(template: Column) -> Column:
    return F.regexp_count(template, F.lit(WILDCARD_RX))


def template_regex_lazy(template: Column) -> Column:
    """Anchored regex with a lazy group per wildcard."""
    return _anchored(_wild_as(escape_regex(template), "(.*?)"))


def template_regex_ws(template: Column) -> Column:
    """As the lazy form, blanks match any white space; NULL without a wildcard."""
    body = F.replace(escape_regex(template), F.lit(" "), F.lit(r"\s+"))
    return F.when(
        F.contains(template, F.lit(WILDCARD)), _anchored(_wild_as(body, "(.*?)"))
    )


def template_regex_token(template: Column) -> Column:
    """As the white-space form, but a wildcard stands for non-blank characters only."""
    body = F.replace(escape_regex(template), F.lit(" "), F.lit(r"\s+"))
    return _anchored(_wild_as(body, r"(\S+?)"))


def _line_mode(regex: Column) -> Column:
    """Only a line feed ends a line for ``.`` and ``$``."""
    return F.concat(F.lit("(?d)"), regex)


def matches(text: Column, regex: Column) -> Column:
    return F.rlike(text, _line_mode(regex))


def template_parts(template: Column) -> Column:
    """The constant parts around the wildcards."""
    return F.split(template, WILDCARD_RX)


def _filled(text: Column, parts: Column, least: int = 0) -> Column:
    """Values between the constant ``parts``, NULL where they do not cover ``text``; ``parts`` must be bound.

    Each value is the shortest of at least ``least`` characters without a line feed; the text may end with one
    more.  No value needs to grow again: where a match exists, the earliest place of a part leaves the most room
    for the rest, and a part that holds a line feed has only one place.  So the cost is one search per part.
    """
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    size = F.length(text)

    def one_line(start: Column, end: Column) -> Column:
        return ~F.contains(F.substring(text, start, end - start), F.lit("\n"))

    def step(acc: Column, part: Column) -> Column:
        pos = acc["pos"]
        at = F.when(part == "", F.least(pos + least, size + 1)).otherwise(
            F.call_function("locate", part, text, pos + least)
        )
        found = (pos > 0) & (at >= pos + least) & one_line(pos, at)
        return F.when(
            found,
            F.struct(
                (at + F.length(part)).alias("pos"),
                F.concat(acc["caps"], F.array(F.substring(text, pos, at - pos))).alias("caps"),
            ),
        ).otherwise(F.struct(F.lit(0).alias("pos"), acc["caps"].alias("caps")))

    def closed(acc: Column, end: Column) -> Column:
        """All values, if the last part stands at ``end``."""
        pos = acc["pos"]
        fits = (pos > 0) & (end >= pos + least) & (F.substring(text, end, F.length(last)) == last)
        return F.when(
            fits & one_line(pos, end), F.concat(acc["caps"], F.array(F.substring(text, pos, end - pos)))
        )

    start = F.when(F.startswith(text, first), F.length(first) + 1).otherwise(F.lit(0))
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    state = F.aggregate(
        inner, F.struct(start.alias("pos"), F.array().cast("array<string>").alias("caps")), step
    )
    end = size - F.length(last) + 1
    several = let(
        lambda acc: F.coalesce(F.when(F.endswith(text, F.lit("\n")), closed(acc, end - 1)), closed(acc, end)),
        state,
    )
    whole = F.when((text == first) | (text == F.concat(first, F.lit("\n"))), F.array().cast("array<string>"))
    return F.when(F.size(parts) == 1, whole).otherwise(several)


def matches_template(log: Column, template: Column) -> Column:
    """Does the template, with lazy wildcards, cover the log line?"""
    covered = let(lambda text, parts: _filled(text, parts).isNotNull(), log, template_parts(template))
    return F.when(log.isNotNull() & template.isNotNull(), covered)


def is_abstract(x: Column, y: Column) -> Column:
    """Is template ``x`` more general than the template or message ``y``?  False for a null ``y``.

    A wildcard stands for characters of one word, a blank for white space; so both are compared word by word
    and gap by gap.
    """

    def covers(v: Column, w: Column) -> Column:
        return F.when(
            F.contains(v, F.lit(WILDCARD)),
            let(lambda text, parts: _filled(text, parts, 1).isNotNull(), w, template_parts(v)),
        ).otherwise(v == w)

    def wide_enough(v: Column, w: Column) -> Column:
        exact = F.concat(F.lit("^"), F.replace(v, F.lit(" "), F.lit(r"\s+")), F.lit("$"))
        return F.when(F.trim(v) == "", F.length(w) >= F.length(v)).otherwise(F.rlike(w, exact))

    def fits(text: Column) -> Column:
        return let(
            lambda a, b, gaps_a, gaps_b: (F.size(a) == F.size(b))
            & F.forall(F.zip_with(gaps_a, gaps_b, wide_enough), lambda ok: ok)
            & F.forall(F.zip_with(a, b, covers), lambda ok: ok),
            F.split(x, r"\s+"),
            F.split(text, r"\s+"),
            F.regexp_extract_all(x, F.lit(r"\s+"), F.lit(0)),
            F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0)),
        )

    shorter = F.substring(y, F.lit(1), F.length(y) - 1)
    whole = fits(y) | (F.endswith(y, F.lit("\n")) & fits(shorter))
    return F.coalesce(whole, F.lit(False))


def group_references(n_groups: Column) -> Column:
    """Replacement text that lists all groups of a match, for :func:`captures`."""
    return F.when(
        n_groups > 0,
        F.concat(
            F.lit(_MARK),
            F.array_join(
                F.transform(F.sequence(F.lit(1), n_groups), lambda i: F.concat(F.lit("$"), i)),
                _SEP,
            ),
        ),
    )


def captures(
    text: Column, regex: Column, n_groups: Column, references: Column | None = None
) -> Column:
    """Captured groups of an anchored ``regex``; NULL if it does not match or has no groups.

    One regex pass gives all groups.  ``references`` may be computed once per template and passed in.
    """
    rx = _line_mode(regex)
    if references is None:
        references = group_references(n_groups)
    fast = let(
        lambda packed: F.when(
            F.startswith(packed, F.lit(_MARK)), F.split(F.substring(packed, 2, 2**31 - 1), _SEP)
        ),
        F.regexp_replace(text, rx, references),
    )
    slow = F.when(
        F.rlike(text, rx),
        F.transform(
            F.sequence(F.lit(1), n_groups),
            lambda i: F.call_function("regexp_extract", text, rx, i),
        ),
    )
    return F.when(
        n_groups > 0, F.when(F.rlike(text, F.lit(_AMBIGUOUS)), slow).otherwise(fast)
    )


def packed_captures(text: Column, regex: str, n_groups: int) -> Column:
    """All groups of an anchored constant ``regex`` as one text, in one pass.

    The text itself if the regex does not match; NULL if the text holds a line feed or a mark that tells groups apart.
    """
    references = _MARK + _SEP.join(f"${k + 1}" for k in range(n_groups))
    plain = ~(F.contains(text, F.lit("\n")) | F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_SEP)))
    return F.when(plain, F.regexp_replace(text, F.lit(f"(?d){regex}"), F.lit(references)))


def unpacked_captures(packed: Column) -> Column:
    """The groups in a text of :func:`packed_captures`, as the only element of an array; NULL without a match."""
    return F.when(F.startswith(packed, F.lit(_MARK)), F.array(F.split(F.substring(packed, 2, 2**31 - 1), _SEP)))


def template_captures(log: Column, template: Column, parts: Column | None = None) -> Column:
    """Values at the wildcards of a template; NULL without a match or without wildcards.

    The constant parts may be computed once per template.
    """
    parts = template_parts(template) if parts is None else parts
    return let(lambda text, p: F.when(F.size(p) > 1, _filled(text, p)), log, parts)


def extract_params(log: Column, template: Column) -> Column:
    """Parameter values of a line under a template, as true substrings; NULL without a match."""
    return template_captures(log, template)


def drop_empty_wildcards(template: Column, params: Column) -> Column:
    """Remove the wildcards whose parameter is empty."""
    parts = F.split(template, WILDCARD_RX)
    tail = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    rebuilt = F.concat(
        F.element_at(parts, 1),
        F.array_join(
            F.zip_with(
                tail,
                params,
                lambda part, value: F.concat(
                    F.when(value == "", F.lit("")).otherwise(F.lit(WILDCARD)), part
                ),
            ),
            "",
        ),
    )
    return F.when(F.array_contains(params, ""), rebuilt).otherwise(template)


def align_nulls(log: Column, template: Column) -> Column:
    """Remove the wildcards that captured nothing; a template that does not match stays as it is."""
    return let(
        lambda t, params: drop_empty_wildcards(t, params), template, extract_params(log, template)
    )


def _segments(log: Column, template: Column) -> Column:
    """A line cut into constant, parameter, constant, …; NULL where the template does not match.

    Both texts have single spaces only, so the constants are the template's own.
    """
    parts = F.split(template, WILDCARD_RX)
    cut = let(
        lambda params: F.when(
            params.isNotNull(),
            F.concat(
                F.flatten(
                    F.zip_with(
                        F.slice(parts, F.lit(1), F.size(params)), params, lambda c, p: F.array(c, p)
                    )
                ),
                F.slice(parts, F.lit(-1), F.lit(1)),
            ),
        ),
        template_captures(log, template),
    )
    return F.when(F.contains(template, F.lit(WILDCARD)), cut).otherwise(F.array(log))


def align_tags(log: Column, template: Column) -> Column:
    """Tagger tokens of a labelled line as ``array<struct<token, space_before, tag>>``; tag 1 = parameter.

    NULL where the label does not match its line, so that callers can drop and count such rows.
    """

    def tagged(kept: Column, segment: Column, i: Column) -> Column:
        # an empty segment has no token and does not change what stands before the next
        before = F.coalesce(F.get(kept, i - 1)["text"], F.lit(""))
        text = F.when(
            segment["param"], F.concat(F.when(F.endswith(before, F.lit(" ")), " ").otherwise(""), segment["text"])
        ).otherwise(F.rtrim(segment["text"]))
        return F.transform(
            tagger_pieces(text),
            lambda p: F.struct(
                F.ltrim(p).alias("token"),
                F.startswith(p, F.lit(" ")).alias("space_before"),
                segment["param"].cast("int").alias("tag"),
            ),
        )

    def filled(segments: Column) -> Column:
        marked = F.transform(segments, lambda s, i: F.struct(s.alias("text"), (i % 2 == 1).alias("param")))
        return F.filter(marked, lambda s: s["text"] != "")

    return let(
        lambda kept: F.flatten(F.transform(kept, lambda segment, i: tagged(kept, segment, i))),
        filled(let(_segments, normalize_ws(log), normalize_ws(template))),
    )


def tags_to_template(tokens: Column) -> Column:
    """Rebuild a template from ``array<struct<token, space_before, tag>>``."""
    return let(_rebuilt, tokens)


def _rebuilt(tokens: Column) -> Column:
    def piece(t: Column, i: Column) -> Column:
        space = F.when(t.getField("space_before"), F.lit(" ")).otherwise(F.lit(""))
        # element_at counts from 1, so position i is the token before t
        previous = F.when(i > 0, F.element_at(tokens, i))
        follows_wild = F.coalesce(
            (previous.getField("tag") == 1)
            | F.contains(previous.getField("token"), F.lit(WILDCARD)),
            F.lit(False),
        )
        return (
            F.when(t.getField("tag") == 0, F.concat(space, t.getField("token")))
            .when(t.getField("space_before") | ~follows_wild, F.concat(space, F.lit(WILDCARD)))
            .otherwise(F.lit(""))
        )

    return F.trim(F.array_join(F.transform(tokens, piece), ""))
