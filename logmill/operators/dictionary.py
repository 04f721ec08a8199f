"""The template dictionary as a table, and the join that finds the best template of a line.

A dictionary has the columns ``template_id``, ``template`` and ``text`` (its matching tokens joined by a
space).  :func:`index_dictionary` adds what the join needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.align import extract_params
from ..functions.binding import let
from ..functions.distance import lcs_similarity
from ..functions.patterns import WILDCARD, WILDCARD_RX
from ..functions.text import is_valid_template, match_text, normalize_ws, split_text, words
from ..session import discard, materialize, scratch_path, stored
from .pairs import nearest
from .scale import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    checked_join,
    digest,
    is_small,
    key_filter,
    lookup_join,
    with_counts,
    with_sequence,
)

DICTIONARY_SCHEMA = "template_id bigint, template string, text string"
#: Candidates are ranked by one decimal: static tokens, then wildcards, then template id.
_RANK = "decimal(38,0)"


def empty_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DICTIONARY_SCHEMA)


def _insertable(templates: DataFrame, arrival: Column | None) -> tuple[DataFrame, list[Column]]:
    """Templates, one per text, and the order in which they get their ids; the bare wildcard and empty texts are left out.

    Without ``arrival`` only templates are shuffled, and stored once; their texts come again behind the sort.
    """
    named = templates.withColumn("text", match_text(F.col("template")))
    named = named.where((F.col("text") != "") & (F.col("template") != WILDCARD))
    if arrival is None:
        one = named.select("template", digest(F.col("text")).alias("_same")).groupBy("_same").agg(F.min("template").alias("template"))
        return one, [F.col("template")]
    named = named.withColumn("arrival", arrival)
    one = named.groupBy("text").agg(F.min("arrival").alias("arrival"), F.min_by("template", "arrival").alias("template"))
    return one.withColumn("_same", digest(F.col("text"))), [F.col("arrival"), F.col("text")]


def new_templates(dictionary: DataFrame, templates: DataFrame, arrival: Column | None = None) -> DataFrame:
    """The templates that the dictionary lacks, with dense ids behind its own: what :func:`add_templates` appends."""
    one, order = _insertable(templates, arrival)
    rows, last = dictionary.agg(F.count(F.lit(1)), F.max("template_id")).first()
    if rows:
        one = one.join(dictionary.select(digest(F.col("text")).alias("_same")), "_same", "left_anti")
    one = stored(one.drop("_same"), "templates")
    text = {"text": match_text(F.col("template"))} if arrival is None else {}
    numbered = with_sequence(one, order, "template_id", 0 if last is None else last + 1, **text)
    discard(one)
    return numbered.select("template_id", "template", "text")


def add_templates(
    dictionary: DataFrame, templates: DataFrame, arrival: Column | None = None
) -> DataFrame:
    """Append the templates that are new, with dense ids in order of ``arrival`` (default: the template)."""
    appended = new_templates(dictionary, templates, arrival)
    return dictionary.select("template_id", "template", "text").unionByName(appended)


def remove_templates(dictionary: DataFrame, templates: DataFrame) -> DataFrame:
    """Delete templates by their tokens; the other ids stay."""
    gone = templates.select(match_text(F.col("template")).alias("text")).distinct()
    return dictionary.join(gone, "text", "left_anti").select("template_id", "template", "text")


def _covers(line: Column, parts: Column, strict: bool) -> Column:
    """Do a template's ``parts`` (its text with a space at both ends, cut at the wildcards) cover a line?

    A wildcard runs to a place where a token starts.  Strict: only the first occurrence of the token after a
    wildcard is tried.  Relaxed: the earliest place of every part leaves the most room for the rest.  Neither goes
    back, so the cost is one search per part.
    """
    line = F.concat(F.lit(" "), line)
    size = F.length(line)

    def step(pos: Column, part: Column) -> Column:
        # parts begin and end with a space, which neighbours share
        if strict:
            at = F.call_function(
                "locate", F.concat(F.substring_index(part, " ", 2), F.lit(" ")), line, pos
            )
            fits = F.substring(line, at, F.length(part)) == part
        else:
            at = F.call_function("locate", part, line, pos)
            fits = F.lit(True)
        return F.when((pos > 0) & (at > 0) & fits, at + F.length(part) - 1).otherwise(F.lit(0))

    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    start = F.when(F.startswith(line, first), F.length(first)).otherwise(F.lit(0))
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    pos = F.aggregate(inner, start, step)
    if strict:
        ends = let(lambda p: step(p, last) == size, pos)
    else:
        ends = let(
            lambda p: (p > 0) & F.endswith(line, last) & (p <= size - F.length(last) + 1), pos
        )
    several = F.when(last == " ", pos > 0).otherwise(ends)
    return F.when(F.size(parts) == 1, line == first).otherwise(several)


#: A key takes this many of a line's first tokens at most.
_PREFIX = 2
#: What a key holds next to the first tokens: the whole text, two neighbours, one token, or nothing more.
_WHOLE, _PAIR, _TOKEN, _NONE = range(4)
#: Stands behind the last token; no token holds a blank.
_END = " "


def _first(tokens: Column, prefix: int) -> Column:
    return F.array_join(F.slice(tokens, 1, prefix), " ") if prefix else F.lit("")


def _start(prefix: int, tokens: Column) -> Column:
    """A number for a line's first tokens."""
    return F.xxhash64(_first(tokens, prefix))


def _key(prefix: int | Column, kind: int, start: Column, *feature: Column) -> Column:
    return F.xxhash64(F.lit(prefix), F.lit(kind), start, *feature)


def _in_tokens(df: DataFrame, *more: str) -> DataFrame:
    """A row for each token ``_x.a`` of ``_t`` at ``_pos``, with the next one as ``_x.b``; the end of the text counts as a token."""
    following = F.slice(F.concat("_t", F.array(F.lit(_END))), 2, F.size("_t"))
    both = F.arrays_zip(F.col("_t").alias("a"), following.alias("b"))
    return df.select(*more, F.size("_t").alias("_n"), F.posexplode_outer(both).alias("_pos", "_x"))


@dataclass(frozen=True)
class Index:
    """A dictionary, and in ``keys`` a row of numbers for each template; the texts stay in the dictionary alone."""

    known: DataFrame
    keys: DataFrame
    strict: bool


def index_dictionary(dictionary: DataFrame, strict: bool = True) -> Index:
    """Store what the join needs: a ``key`` and the rank of each template.

    ``key`` is what a line must hold to be tried: up to two first tokens of the template, and behind them its rarest pair
    of neighbours, else its rarest token; a template without a wildcard asks for its whole text.  ``prefix`` and
    ``kind`` tell how the key was made.  How rare is asked of large dictionaries only; otherwise the longest pair is taken.
    """
    tokens = F.col("_t")
    fixed = F.array_position(tokens, WILDCARD) - 1
    base = dictionary.select("template_id", F.xxhash64("text").alias("_whole"), split_text(F.col("text")).alias("_t"))
    base = base.withColumn("prefix", F.when(fixed >= 0, F.least(fixed, F.lit(_PREFIX)).cast("int")))
    whole = base.where("prefix IS NULL").select(
        "template_id",
        F.size("_t").alias("_n"),
        F.lit(0).cast("bigint").alias("n_wild"),
        F.lit(0).alias("prefix"),
        F.lit(_WHOLE).alias("kind"),
        _key(0, _WHOLE, F.col("_whole")).alias("key"),
    )
    start = F.when(F.col("prefix") == 0, _start(0, tokens))
    for prefix in range(1, _PREFIX + 1):
        start = start.when(F.col("prefix") == prefix, _start(prefix, tokens))
    wild = base.where("prefix IS NOT NULL").withColumn("_start", start).withColumn("_row", F.monotonically_increasing_id())
    wild = _in_tokens(wild, "_row", "template_id", "prefix", "_start")
    a, b = F.col("_x.a"), F.col("_x.b")
    pair = (a != WILDCARD) & (b != WILDCARD) & (F.col("_pos") >= F.greatest("prefix", F.lit(1)) - 1)
    single = (a != WILDCARD) & (F.col("_pos") >= F.col("prefix"))
    size = F.length(a) + F.when(pair, F.length(F.trim(b))).otherwise(0)
    wild = wild.select(
        "_row",
        "template_id",
        "prefix",
        "_n",
        (a == WILDCARD).alias("_wild"),
        F.when(pair, F.lit(_PAIR)).when(single, F.lit(_TOKEN)).otherwise(F.lit(_NONE)).alias("kind"),
        F.when(pair, F.xxhash64(a, b)).when(single, F.xxhash64(a)).alias("_feature"),
        F.when(pair, _key(F.col("prefix"), _PAIR, F.col("_start"), a, b))
        .when(single, _key(F.col("prefix"), _TOKEN, F.col("_start"), a))
        .otherwise(_key(F.col("prefix"), _NONE, F.col("_start")))
        .alias("key"),
        (255 - F.least(size, F.lit(255))).alias("_short"),
    )
    large = dictionary.count() > BROADCAST_ROWS
    wild = with_counts(wild, "_feature", "_count") if large else wild.withColumn("_count", F.lit(0))
    # kind before rarity before length
    order = F.col("kind") * F.lit(1 << 50) + F.coalesce("_count", F.lit(0)) * 256 + F.col("_short")
    wild = wild.withColumn("_order", order).groupBy("_row", "template_id", "_n", "prefix")
    wild = wild.agg(F.count_if("_wild").alias("n_wild"), F.min_by("key", "_order").alias("key"), F.min("_order").alias("_order"))
    wild = wild.withColumn("kind", F.expr("cast(shiftright(_order, 50) as int)"))
    keys = wild.select(whole.columns).unionByName(whole).withColumn("n_static", F.col("_n") - F.col("n_wild"))
    rank = (
        F.expr("cast(999999999 - n_static as decimal(38,0)) * 10000000000000000000000000000BD")
        + F.expr("cast(n_wild as decimal(38,0)) * 10000000000000000000BD")
        + F.col("template_id").cast(_RANK)
    )
    keys = keys.select("n_static", "prefix", "kind", "key", rank.cast(_RANK).alias("rank"))
    return Index(dictionary.select("template_id", "template", "text"), stored(keys, "keys"), strict)


def _id_of(rank: Column) -> Column:
    return F.pmod(rank, F.expr("10000000000000000000BD")).cast("bigint")


def _tried(lines: DataFrame, index: Index, small: bool | None, least: int = 0, below: int | None = None) -> DataFrame:
    """The templates whose key a line holds: _line_id, rank.

    Lines give only the kinds of keys that ``keys`` has.  Kinds with few templates are broadcast, such as those that
    most lines would share; the others meet by key, once a filter has left out nearly all keys that no template has.  ``least`` and ``below``: of templates with so many
    static tokens only.
    """
    keys = index.keys.where(F.col("n_static") >= least)
    keys = keys if below is None else keys.where(F.col("n_static") < below)
    tokens = split_text(F.col("_text"))
    made = keys.groupBy("prefix", "kind").agg(F.count(F.lit(1)).alias("n")).collect()
    few = sum(r.n for r in made) <= BROADCAST_ROWS
    groups: dict[bool, list] = {True: [], False: []}
    for r in sorted(made):
        groups[(few or r.n <= BROADCAST_ROWS // 16) if small is None else small].append((r.prefix, r.kind))

    # exploded before they are hashed: expressions inside lambdas are interpreted; texts are not copied to each token
    placed = lines.select("_line_id", F.xxhash64("_text").alias("_whole"), tokens.alias("_t"))
    starts = {f"_start{p}": _start(p, F.col("_t")) for p in range(_PREFIX + 1)}
    placed = _in_tokens(placed.withColumns(starts), "_line_id", "_whole", *starts)

    def key(prefix: int, kind: int) -> Column:
        start, pos = F.col(f"_start{prefix}"), F.coalesce("_pos", F.lit(0))
        if kind == _WHOLE:
            return F.when(pos == 0, _key(0, _WHOLE, F.col("_whole")))
        if kind == _PAIR:
            return F.when(pos >= max(prefix, 1) - 1, _key(prefix, _PAIR, start, F.col("_x.a"), F.col("_x.b")))
        if kind == _TOKEN:
            return F.when(pos >= prefix, _key(prefix, _TOKEN, start, F.col("_x.a")))
        return F.when(pos == 0, _key(prefix, _NONE, start))

    found = lines.select("_line_id", F.lit(None).cast(_RANK).alias("rank")).where("false")
    for broadcast, kinds in groups.items():
        if not kinds:
            continue
        asked = F.explode(F.array(*(key(*k) for k in kinds)))
        keyed = placed.select("_line_id", "_n", asked.alias("key")).where("key IS NOT NULL")
        at = F.struct("prefix", "kind")
        wanted = keys.where(at.isin(*(F.struct(F.lit(p).alias("prefix"), F.lit(k).alias("kind")) for p, k in kinds)))
        wanted = wanted.select("key", "n_static", "rank")
        if not broadcast:
            keyed = key_filter(wanted, "key")(keyed, "key")
        met = keyed.join(F.broadcast(wanted) if broadcast else wanted, "key").where("n_static <= _n")
        found = found.unionByName(met.select("_line_id", "rank"))
    return found


#: Pairs whose texts are on disk at once: a share of all pairs, and small tables are not cut.
_SLICES, _PAIRS_OF_A_SLICE = 4, 250_000


def _covering(lines: DataFrame, pairs: DataFrame, index: Index, small: bool, few: bool = False) -> list[DataFrame]:
    """Of stored pairs of a line and a rank, those whose template covers the line, as stored tables.

    Line and template travel slice by slice, and only what a slice wants, so that never all texts are on disk once more.
    ``few`` tells that many lines have no pair.
    """
    slices = 1 if small else max(1, min(_SLICES, pairs.count() // _PAIRS_OF_A_SLICE))
    known = index.known.select("template_id", F.col("text").alias("_template"))
    found = []
    for n in range(slices):
        some, texts, templates = pairs, lines.select("_line_id", "_text"), known
        if slices > 1:
            some, texts = (df.where(F.pmod(F.xxhash64("_line_id"), F.lit(slices)) == n) for df in (some, texts))
        some = some.withColumn("template_id", _id_of(F.col("rank")))
        if few:
            texts = key_filter(some, "_line_id")(texts, "_line_id")
        if few or slices > 1:
            templates = templates if small else key_filter(some, "template_id")(templates, "template_id")
        met = some.join(F.broadcast(templates) if small else templates, "template_id").join(texts, "_line_id")
        line = F.when(F.col("_text") == "", "").otherwise(F.concat("_text", F.lit(" ")))
        ends = F.split(F.concat("_template", F.lit(" ")), r"<\*> ?")
        parts = F.split(F.concat(F.lit(" "), "_template", F.lit(" ")), WILDCARD_RX)
        met = met.select("_line_id", "rank", line.alias("_line"), ends.alias("_ends"), parts.alias("_parts"))
        met = met.where(F.startswith("_line", F.element_at("_ends", 1)) & F.endswith("_line", F.element_at("_ends", -1)))
        met = met.where(_covers(F.col("_line"), F.col("_parts"), index.strict))
        found.append(stored(met.select("_line_id", "rank"), "covering"))
    return found


def _union(tables: list[DataFrame]) -> DataFrame:
    result = tables[0]
    for more in tables[1:]:
        result = result.unionByName(more)
    return result


def numbered_lines(contents: DataFrame, column: str) -> DataFrame:
    """Distinct contents, which are not null, with ``_line_id``, ``_text`` (matching tokens) and ``_same``, which stands for the content in joins."""
    content = F.col(column)
    return contents.select(
        F.monotonically_increasing_id().alias("_line_id"), "*", match_text(content).alias("_text"), digest(content).alias("_same")
    )


def best_ranks(lines: DataFrame, index: Index, small: bool | None = None) -> DataFrame:
    """The rank of the best template of each line that has one, stored: _line_id, rank.  ``lines`` is stored too.

    Best is: most static tokens, then fewest wildcards, then lowest id.

    Keys of a line's tokens travel with a line number only and name the templates to try.  Then line and template meet
    by number: first the best-ranked template of each line, which decides if it covers the line; only lines that it does not
    cover meet their others.  ``small`` tells whether the index may be broadcast (default: its size decides).
    """
    tries, small = small, is_small(index.known) if small is None else small
    found: list[DataFrame] = []
    below, rest = None, lines
    for least in [0] if small else _TIERS:
        if below is not None:
            # only lines that no template of more static tokens covers; a filter keeps the texts of the others where they are
            left = stored(lines.select("_line_id").join(_union(found).select("_line_id"), "_line_id", "left_anti"), "left")
            rest = key_filter(left, "_line_id")(lines, "_line_id")
        found += _ranks(rest, _tried(rest, index, tries, least, below), index, small)
        if below is not None:
            discard(left)
        below = least
    if len(found) == 1:
        return found[0]
    best = stored(_union(found).groupBy("_line_id").agg(F.min("rank").alias("rank")), "ranks")
    discard(*found)
    return best


#: Lines meet templates of so many static tokens at least, then those of fewer if none covers them.
_TIERS = (8, 3, 0)


def _ranks(lines: DataFrame, tried: DataFrame, index: Index, small: bool) -> list[DataFrame]:
    """Of the templates to try, the best one that covers a line, as stored tables: _line_id, rank."""
    tried = stored(tried, "tried")
    top = stored(tried.groupBy("_line_id").agg(F.min("rank").alias("rank")), "top")
    found = _covering(lines, top, index, small)
    done = _union(found).select("_line_id")
    lower = tried.join(done, "_line_id", "left_anti").join(top.withColumnRenamed("rank", "_top"), "_line_id").where("rank > _top")
    others = stored(lower.select("_line_id", "rank").distinct(), "others")
    discard(tried, top)
    if not others.isEmpty():
        later = _covering(lines, others, index, small, few=True)
        found.append(stored(_union(later).groupBy("_line_id").agg(F.min("rank").alias("rank")), "later"))
        discard(*later)
    discard(others)
    return found


def named_templates(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add template_id and template to rows with a rank."""
    names = dictionary.select("template_id", "template")
    named = found.withColumn("template_id", _id_of(F.col("rank")))
    return named.join(F.broadcast(names) if is_small(names) else names, "template_id")


def best_templates(
    contents: DataFrame, index: Index, column: str = "Content", keep_rank: bool = False, small: bool | None = None
) -> DataFrame:
    """The best template of each distinct content that has one: content, template_id, template.

    ``contents`` holds distinct texts.  ``keep_rank`` adds the rank, by which results of several indexes compare.
    """
    lines = stored(numbered_lines(contents.select(column).where(F.col(column).isNotNull()), column), "lines")
    found = named_templates(best_ranks(lines, index, small), index.known)
    order = ["rank"] if keep_rank else []
    return lines.select("_line_id", column).join(found, "_line_id").select(column, "template_id", "template", *order)


def match_dictionary(
    logs: DataFrame, index: Index, column: str = "Content", params: bool = False
) -> DataFrame:
    """Each line with the best template that covers it, or nulls.

    Equal lines are looked up once, and lines get their template by a digest.  ``params`` adds the values at the wildcards.
    """
    contents = logs.select(column).where(F.col(column).isNotNull()).distinct()
    lines = stored(numbered_lines(contents, column).drop(column), "lines")
    found = best_ranks(lines, index)
    best = lines.select("_line_id", "_same").join(found, "_line_id")
    best = stored(named_templates(best, index.known).select("_same", "template_id", "template"), "best")
    discard(lines, found)
    result = logs.withColumn("_same", digest(F.col(column))).join(best, "_same", "left").select(*logs.columns, "template_id", "template")
    if params:
        value = extract_params(normalize_ws(F.col(column)), F.col("template"))
        result = result.withColumn("params", value)
    return result


#: Of a line's first tokens, so many are masked at most.
_MASKED = 32


def _masked(lines: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """Lines with tokens, and ``_mask``: their first ``longest`` tokens as text, where a wildcard stands for a token
    that no template has at its place.

    Lines with one mask share prefixes with the same templates.  Places are masked as long as their words may be
    broadcast together; what lies behind stays as it is.
    """
    words = known.select(F.posexplode(F.slice("_ttokens", 1, _MASKED)).alias("pos", "word")).where(F.col("word") != WILDCARD)
    words = materialize(words.distinct())
    sizes = words.groupBy("pos").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("word")).alias("bytes"))
    size = {r.pos: (r.rows, r.bytes) for r in sizes.collect()}
    mask, rows, bytes_ = [], 0, 0
    for pos in range(min(longest, _MASKED)):
        more = size.get(pos, (0, 0))
        rows, bytes_ = rows + more[0], bytes_ + more[1]
        if rows > BROADCAST_ROWS or bytes_ > BROADCAST_BYTES:
            break
        word = f"_word{pos}"
        own = words.where(F.col("pos") == pos).select(F.col("word").alias(word))
        lines = lines.join(F.broadcast(own), F.get("_tokens", F.lit(pos)) == F.col(word), "left")
        mask.append(F.when(F.size("_tokens") > pos, F.coalesce(word, F.lit(WILDCARD))))
    if len(mask) < longest:
        mask.append(F.slice("_tokens", len(mask) + 1, longest - len(mask)))
    return lines.withColumn("_mask", F.concat_ws(" ", *mask))


def related_templates(
    contents: DataFrame, dictionary: DataFrame, column: str = "Content"
) -> DataFrame:
    """The templates that share the longest token prefix with a line: content, template_id, template, prefix_len.

    A wildcard in a template's prefix stands for one token, the first one too; a line that shares not even the first
    token has no row.  Lines are masked and stored once; only their distinct masks go down the tree of prefixes, and
    what they find is joined back.
    """
    spark = contents.sparkSession
    tokens = split_text(F.coalesce(match_text(F.col(column)), F.lit("")))
    known = materialize(
        dictionary.select("template_id", "template", split_text(F.col("text")).alias("_ttokens"), F.lit(0).cast("long").alias("_node"))
    )
    longest = max(known.agg(F.max(F.size("_ttokens"))).first()[0] or 0, 0)
    lines = contents.select(column).distinct().withColumn("_tokens", tokens)
    lines = _masked(lines, known, longest).select(column, "_mask")
    # as Parquet, whose columns keep masks apart and small
    path = scratch_path(spark, "masked")
    lines.write.parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    found = _deepest(lines.select("_mask").distinct(), known, longest)
    return lookup_join(lines, found, ["_mask"], "inner").select(column, "template_id", "template", "prefix_len")


def _deepest(masks: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """The templates that share the longest prefix with a mask: _mask, template_id, template, prefix_len.

    Masks and templates go down the tree of prefixes together, one token at a time: a node is a hash of the prefix, and a
    mask asks by equi-join whether a template has its next token or a wildcard there.  So a mask meets the nodes of its
    own path, not all templates of its first token.
    """
    lines = materialize(
        masks.select("_mask", split_text(F.col("_mask")).alias("_tokens"), F.lit(0).cast("long").alias("_node")).withColumn(
            "_line_id", F.monotonically_increasing_id()
        )
    )
    ended = []
    for depth in range(1, longest + 2):
        at = F.lit(depth - 1)

        def child(token: Column) -> Column:
            return F.xxhash64("_node", token)

        below = known.where(F.size("_ttokens") >= depth).withColumn("_node", child(F.get("_ttokens", at)))
        below = materialize(below)
        own = F.array(child(F.get("_tokens", at)), child(F.lit(WILDCARD)))
        asked = lines.where(F.size("_tokens") >= depth).withColumn("_node", F.explode(F.array_distinct(own)))
        deeper = materialize(lookup_join(asked, below.select("_node").distinct(), ["_node"], "left_semi"))
        if depth > 1:
            last = lines.join(deeper.select("_line_id").distinct(), "_line_id", "left_anti")
            ended.append(
                checked_join(last, known, ["_node"], salt_by=F.col("_line_id"), small=is_small(known))
                # the hash has found them, the tokens decide
                .where(
                    F.forall(
                        F.zip_with(F.slice("_ttokens", 1, depth - 1), F.slice("_tokens", 1, depth - 1), lambda t, w: (t == w) | (t == WILDCARD)),
                        lambda same: same,
                    )
                )
                .select("_mask", "template_id", "template", F.lit(depth - 1).alias("prefix_len"))
            )
        if deeper.isEmpty():
            break
        lines, known = deeper, below
    if not ended:
        kept = known.select(F.lit("").alias("_mask"), "template_id", "template", F.lit(0).alias("prefix_len"))
        return kept.where("false")
    result = ended[0]
    for more in ended[1:]:
        result = result.unionByName(more)
    return result


def merge_similar(
    dictionary: DataFrame, templates: DataFrame, threshold: float = 0.8
) -> DataFrame:
    """Merge new templates into similar known ones, and append the others.

    Similar means: same first token, same number of words and a common-subsequence similarity above
    ``threshold``; the closest known template takes it, ties go to the lowest id.  Words that differ become wildcards, the
    id stays.  Known templates with too few common words are not compared.
    """
    def shaped(df: DataFrame, text: str, *more: str) -> DataFrame:
        first = F.coalesce(F.get(split_text(match_text(F.col("template"))), F.lit(0)), F.lit(""))
        return df.select(
            F.col("template").alias(text), F.size(words(F.col("template"))).alias("n_words"), first.alias("_first"), *more
        )

    new = shaped(templates.select("template").distinct(), "x")
    old = shaped(dictionary, "y", "template_id")
    # a little farther than the threshold, which the exact similarity then decides
    found = nearest(new, old, "lcs", 1, ["n_words", "_first"], tie="template_id", within=1 - threshold + 1e-9)
    taken = found.join(old.select("y", "template_id"), "y").select(
        "template_id", F.col("x").alias("new"), words(F.col("y")).alias("_old"), words(F.col("x")).alias("_new")
    )
    taken = materialize(taken.where(lcs_similarity(F.col("_old"), F.col("_new")) > threshold))
    differing = (
        taken.select(
            "template_id",
            F.posexplode(F.zip_with("_old", "_new", lambda a, b: a != b)).alias("pos", "differs"),
        )
        .where("differs")
        .groupBy("template_id")
        .agg(F.collect_set("pos").alias("_wild"))
    )
    merged = (
        dictionary.join(differing, "template_id", "left")
        .withColumn(
            "template",
            F.when(F.col("_wild").isNull(), F.col("template")).otherwise(
                F.array_join(
                    F.transform(
                        words(F.col("template")),
                        lambda w, i: F.when(F.array_contains("_wild", i), WILDCARD).otherwise(w),
                    ),
                    " ",
                )
            ),
        )
        .select("template_id", "template", match_text(F.col("template")).alias("text"))
    )
    rest = templates.join(taken.select(F.col("new").alias("template")), "template", "left_anti")
    return add_templates(merged, rest.select("template").distinct())


def valid_templates(templates: DataFrame) -> DataFrame:
    return templates.where(is_valid_template(F.col("template")))
