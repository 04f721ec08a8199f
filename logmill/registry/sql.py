"""SQL building blocks for the equivalent SQL texts (DuckDB dialect, RE2 patterns).

They follow another route than the Spark forms: texts are cut into piece lists and every piece is decided on
its own, where the Spark forms use look-around on whole texts.
"""

from __future__ import annotations

from ..functions.patterns import VOCABULARY_STOP_WORDS

_SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_MATCH = r"!\"#$%&''()+,\-/;:=?@.\[\\\]^_`{|}~"
_PATH = r",!;:=|\"''\[\](){}"
_TOKEN = _PATH + r".\-+@#$%&"

EVENT_LOG = r"""
ev AS (SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
              regexp_extract(props, '(\d+)', 1) AS k FROM events),
event_log AS (
  SELECT event_id + 1 AS "LineId", CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS "Level",
         'svc' || (user_id % 5) AS "Component",
         'user ' || user_id || ' did ' || event_type || ' amount=' || cents || ' key ' || k AS "Content",
         'E_' || event_type AS "EventId",
         'user <*> did ' || event_type || ' amount=<*> key <*>' AS "EventTemplate", ts, event_id
  FROM ev),
event_pred AS (
  SELECT event_id + 1 AS "LineId",
         'user ' || user_id || ' did ' || event_type || ' amount=' || cents || ' key ' || k AS "Content",
         CASE WHEN event_type IN ('click', 'view') THEN 'user <*> did <*> amount=<*> key <*>'
              WHEN event_type = 'error' AND user_id % 2 = 1 THEN 'user <*> did error <*> key <*>'
              ELSE 'user <*> did ' || event_type || ' amount=<*> key <*>' END AS "EventTemplate"
  FROM ev),
event_raw AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'broken line ' || event_id
    ELSE '[' || substr(CAST(ts AS VARCHAR), 1, 19) || '] [' || "Level" || '] ' || "Content" END AS line
  FROM event_log),
seen AS (SELECT DISTINCT "EventTemplate" AS template FROM event_log WHERE "EventId" IN ('E_signup', 'E_purchase')),
pairs AS (SELECT t."LineId", t."Component", t."EventTemplate" AS gt, p."EventTemplate" AS pred
          FROM event_log t JOIN event_pred p ON t."LineId" = p."LineId")"""

ORDER_LOG = """
order_log AS (
  SELECT o_orderkey + 1 AS "LineId",
         'order ' || o_orderkey || ' status ' || o_orderstatus || ' by ' || c_name || ' at /shop/'
           || c_nationkey || '/' || o_custkey AS "Content",
         'order <*> status <*> by <*> at <*>' AS "EventTemplate"
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

LABELLED = """
labelled AS (
  SELECT 'event' AS src, "LineId", "Content" AS log, "EventTemplate" AS template FROM event_log
  UNION ALL SELECT 'order', "LineId", "Content", "EventTemplate" FROM order_log)"""

DOC_LINES = """
doc_lines AS (
  SELECT doc_id, pos, source, "Content" FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS "Content",
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
  WHERE trim("Content") <> ''),
doc_labelled AS (SELECT "Content" AS log, source AS label FROM doc_lines)"""

DOC_MIXED = """
doc_mixed AS (
  SELECT doc_id, pos, array_to_string(list_transform(string_split("Content", ' '), lambda w, i:
    CASE (i - 1 + length(w)) % 11 WHEN 0 THEN w WHEN 1 THEN '<*>' WHEN 2 THEN '#<*>#' WHEN 3 THEN '"<*>"'
      WHEN 4 THEN w || '=<*>:<*>' WHEN 5 THEN '/' || w || '/x'
      WHEN 6 THEN CASE WHEN length(w) % 2 = 0 THEN 'True' ELSE 'null' END
      WHEN 7 THEN length(w) || '.<*>,<*>' WHEN 8 THEN 'ab<*>' || w WHEN 9 THEN '#<*>' ELSE '<*>' END), ' ') AS "Content"
  FROM doc_lines)"""

TEXTS = """
texts AS (
  SELECT 'event' AS src, CAST("LineId" AS VARCHAR) AS id, "Content" AS s FROM event_log
  UNION ALL SELECT 'event_template', CAST("LineId" AS VARCHAR), "EventTemplate" FROM event_log
  UNION ALL SELECT 'order', CAST("LineId" AS VARCHAR), "Content" FROM order_log
  UNION ALL SELECT 'doc', doc_id || ':' || pos, "Content" FROM doc_lines
  UNION ALL SELECT 'mixed', doc_id || ':' || pos, "Content" FROM doc_mixed)"""


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def on_events(body: str, *more: str) -> str:
    return with_ctes(body, EVENT_LOG, *more)


def on_labelled(body: str, *more: str) -> str:
    return with_ctes(body, EVENT_LOG, ORDER_LOG, LABELLED, *more)


def on_docs(body: str, *more: str) -> str:
    return with_ctes(body, DOC_LINES, *more)


def on_texts(body: str, *more: str) -> str:
    return with_ctes(body, EVENT_LOG, ORDER_LOG, DOC_LINES, DOC_MIXED, TEXTS, *more)


def per_text(expression: str) -> str:
    """``expression`` of the text ``s`` for every fixture text."""
    return on_texts(f"SELECT src, id, {expression} AS result FROM texts")


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_SPACE}]+', ' ', 'g'))"


def word_list(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def _collapse(pieces: str) -> str:
    """Drop empty pieces, and wildcards right after a wildcard; as one text joined by spaces."""
    joined = f"array_to_string(list_filter({pieces}, lambda p: p <> ''), ' ')"
    return rf"regexp_replace({joined}, '<\*>( <\*>)+', '<*>', 'g')"


def match_text(x: str) -> str:
    pieces = f"regexp_extract_all({squeeze(x)}, '[{_MATCH} ]|[^{_MATCH} ]+')"
    return _collapse(
        f"list_transform({pieces}, lambda p: CASE WHEN contains(p, '<*>') THEN '<*>' "
        f"WHEN p IN ('=', '|', '(', ')', ';') THEN p "
        f"ELSE regexp_replace(p, '[{_MATCH} ]', '', 'g') END)"
    )


def similarity_text(x: str) -> str:
    pieces = f"regexp_extract_all({squeeze(x)}, '[{_MATCH} ]+|[^{_MATCH} ]+')"
    return _collapse(
        f"list_transform({pieces}, lambda p: CASE WHEN contains(p, '<*>') THEN '<*>' "
        f"WHEN regexp_matches(p, '^[{_MATCH} ]') THEN regexp_replace(p, '[^=|()]', '', 'g') ELSE p END)"
    )


def tagger_text(x: str) -> str:
    """Tagger tokens joined by ``~``, a leading space kept."""
    return (
        rf"array_to_string(regexp_extract_all({x}, '( ?[|()\[\]{{}}]| ?[^ |()\[\]{{}}]+)'), '~')"
    )


def corrected(x: str, *, paths: bool, constants: tuple[str, ...], ignore_case: bool) -> str:
    text = squeeze(x)
    if paths:
        pieces = f"regexp_extract_all({text}, '[{_PATH} ]|[^{_PATH} ]+')"
        text = (
            f"array_to_string(list_transform({pieces}, lambda p: "
            f"CASE WHEN regexp_matches(p, '^(/[^/]+)+$') THEN '<*>' ELSE p END), '')"
        )
    words = ", ".join(f"'{c}'" for c in constants)
    is_constant = f"{'lower(p)' if ignore_case else 'p'} IN ({words}) OR " if constants else ""
    pieces = f"regexp_extract_all({text}, '[{_TOKEN} ]|[^{_TOKEN} ]+')"
    return (
        f"array_to_string(list_transform({pieces}, lambda p: CASE WHEN {is_constant}"
        rf"regexp_matches(p, '^\p{{Nd}}+$') OR (contains(p, '<*>') AND NOT contains(p, '/')) "
        f"THEN '<*>' ELSE p END), '')"
    )


def merged(x: str, *separators: str) -> str:
    """Merge wildcards in turn over each class body in ``separators``; empty means adjacent."""
    for sep in separators:
        between = f"[{sep}]" if sep else ""
        x = rf"regexp_replace({x}, '<\*>({between}<\*>)+', '<*>', 'g')"
    return x


def unframed(x: str, left: str, right: str) -> str:
    """Unwrap wildcards between spaces; twice, since neighbours share the space."""
    frame = f" {left}<*>{right} ".replace("'", "''")
    return f"replace(replace({x}, '{frame}', ' <*> '), '{frame}', ' <*> ')"


WORDS = ("true", "false", "null", "root", "admin")


def correct_parse(x: str, extra: tuple[str, ...] = ()) -> str:
    text = merged(corrected(x, paths=True, constants=WORDS + extra, ignore_case=False), ".")
    return rf"regexp_replace({text}, '<\*>([: ]?<\*>)+', '<*>', 'g')"


def correct_legacy(x: str) -> str:
    return merged(corrected(x, paths=True, constants=WORDS, ignore_case=True), ".", "", ":", ",")


def correct_oracle(x: str) -> str:
    return merged(corrected(x, paths=True, constants=WORDS, ignore_case=True), ".", "")


def correct_metric(x: str) -> str:
    text = merged(corrected(x, paths=False, constants=(), ignore_case=False), ".", "")
    text = unframed(unframed(text, "#", "#"), "#", "")
    text = merged(text, ":", "#", "/", "@", ".")
    text = unframed(unframed(text, '"', '"'), "'", "'")
    return merged(text, "", " ")


def escaped(x: str) -> str:
    return rf"regexp_replace({x}, '([\\^$.|?*+()\[\]{{}}])', '\\\1', 'g')"


def regex_of(x: str, group: str, space: str = " ") -> str:
    body = rf"replace({escaped(x)}, '<\*>', '{group}')"
    if space != " ":
        body = rf"replace(replace({escaped(x)}, ' ', '{space}'), '<\*>', '{group}')"
    return f"('^' || {body} || '$')"


def clean(x: str) -> str:
    signs = rf"regexp_replace({x}, ':|\(|\)|=|,|\"|\{{|\}}|@|\[|\]|\||;|\.?!', ' ', 'g')"
    return (
        f"array_to_string(list_filter(string_split({squeeze(signs)}, ' '), "
        rf"lambda w: NOT regexp_matches(w, '\p{{Nd}}')), ' ')"
    )


def signature(x: str) -> str:
    return (
        f"coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all("
        f"regexp_replace({x}, '[0-9A-Za-z, ]+', '', 'g'), '(?s).'))), ''), '')"
    )


_STOP = ", ".join(f"'{w}'" for w in VOCABULARY_STOP_WORDS)

CLUSTERS = f"""
pool AS (SELECT log, label, {clean('log')} AS clean, {signature('log')} AS fine
         FROM (SELECT DISTINCT log, label FROM doc_labelled)),
lines AS (SELECT row_number() OVER (ORDER BY log, label) AS nr, * FROM pool WHERE clean <> ''),
line_words AS (SELECT nr, token FROM (SELECT nr, unnest(string_split(clean, ' ')) AS token FROM lines)
               WHERE length(token) > 2 AND token NOT IN ({_STOP})),
vocab AS (SELECT token, count(*) AS n FROM line_words GROUP BY token),
ranked AS (SELECT nr, d.token, row_number() OVER (PARTITION BY nr ORDER BY n DESC, d.token) AS r
           FROM (SELECT DISTINCT nr, token FROM line_words) d JOIN vocab USING (token)),
keys AS (SELECT nr, string_agg(token, ' ' ORDER BY token) AS coarse FROM ranked WHERE r <= 3 GROUP BY nr),
clustered AS (SELECT log, label, clean, fine, coalesce(coarse, '') AS coarse
              FROM lines LEFT JOIN keys USING (nr)),
sizes AS (SELECT coarse, fine, count(*) AS fine_size FROM clustered GROUP BY coarse, fine)"""

# The strict search, part by part: a part is looked for behind the one before, at the first place of its first token.
_FROM_PLACE = "substr(line, CAST(place AS BIGINT))"
_FOUND = f"strpos({_FROM_PLACE}, ' ' || split_part(part, ' ', 2) || ' ')"
_STEP = f"""CASE WHEN place = '0' OR {_FOUND} = 0 THEN '0'
  WHEN substr(line, CAST(place AS BIGINT) + {_FOUND} - 1, length(part)) <> part THEN '0'
  ELSE CAST(CAST(place AS BIGINT) + {_FOUND} + length(part) - 2 AS VARCHAR) END"""

#: From document lines and the templates of a table ``cut``: ``best``, the best template of each line that has one.
STRICT_MATCH = f"""
lines AS (SELECT DISTINCT "Content", ' ' || {match_text('"Content"')} || ' ' AS line FROM doc_lines),
known AS (SELECT text, min(template) AS template FROM (SELECT template, {match_text('template')} AS text FROM cut)
  WHERE text <> '' AND template <> '<*>' GROUP BY text),
dictionary AS (SELECT *, row_number() OVER (ORDER BY template, text) - 1 AS template_id,
    len(string_split(text, ' ')) AS n_tokens, len(list_filter(string_split(text, ' '), lambda t: t = '<*>')) AS n_wild,
    string_split(' ' || text || ' ', '<*>') AS parts, split_part(text, ' ', 1) AS first_token FROM known),
tried AS MATERIALIZED (
  SELECT lines.*, dictionary.* FROM lines JOIN dictionary ON first_token = split_part(line, ' ', 2)
  WHERE starts_with(line, parts[1]) AND ends_with(line, parts[-1]) AND (n_wild > 0 OR line = parts[1])
  UNION ALL SELECT lines.*, dictionary.* FROM lines JOIN dictionary
    ON first_token = '<*>' AND split_part(line, ' ', 2) <> '<*>' AND ends_with(line, parts[-1]) AND line <> '  '),
covered AS (SELECT *, CASE WHEN n_wild = 0 THEN '0' ELSE list_reduce(
    list_prepend(CAST(length(parts[1]) AS VARCHAR), CASE WHEN parts[-1] = ' ' THEN parts[2 : -2] ELSE parts[2:] END),
    lambda place, part: {_STEP}) END AS place FROM tried),
ordered AS (SELECT "Content", template_id, template,
    row_number() OVER (PARTITION BY "Content" ORDER BY n_tokens - n_wild DESC, n_wild, template_id) AS r
  FROM covered WHERE n_wild = 0 OR (place <> '0' AND (parts[-1] = ' ' OR CAST(place AS BIGINT) = length(line)))),
best AS (SELECT "Content", template_id, template FROM ordered WHERE r = 1)"""
