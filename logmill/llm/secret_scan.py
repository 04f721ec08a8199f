"""Secret scans by rules and corpus-wide ownership, in DataFrame functions only.

Rules find credential assignments, access keys and long hexadecimal strings; looser rules find further candidates.
Every candidate's hash is counted over the whole corpus by distinct texts (repositories) and sources (owners): what
many owners hold in texts of their own is an example, what belongs to one or two looks live, however often its text is
copied.  Only live-looking candidates of
the looser rules become spans; the spans of the base rules all stay and are told apart by the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import attach, stored, whole_text

#: A candidate held by so many owners is an example.
WIDE_OWNERS = 3
#: A text of fewer words is little more than the credential: each owner and document that holds it counts.
COPY_WORDS = 5

# The base rules as (kind, expression, group of the secret, least length of that group)
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of 32 and more, without the many short ones
)
# Looser rules, whose candidates count only if they belong to few owners
LOOSE = (
    ("vendor", r"\b(?:gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 16),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 20),
    ("userinfo", r"\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]{1,64}:([^\x20\x09-\x0D@/:\"']{6,128})@", 1, 6),
)
RULES = BASE + LOOSE
_PLACE = {kind: k for k, (kind, *_) in enumerate(RULES)}
KEY = ("row_key", "text_hash")
MASK = "<SECRET>"


def _key(text: Column) -> list[Column]:
    """Two hashes that stand for (doc_id, text), null ids included."""
    return [F.xxhash64("doc_id", text).alias("row_key"), F.xxhash64(text).alias("text_hash")]


def matches(text: Column, rule: tuple[str, str, int, int]) -> Column:
    """All matches of a rule as (kind, order, gap before, length, secret), from the pieces between them."""
    kind, expression, group, least = rule
    whole = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    empty = F.array().cast("array<struct<kind:string,k:int,gap:int,size:int,secret:string,fits:boolean>>")

    def parts(found: Column, secrets: Column, pieces: Column) -> Column:
        return F.transform(
            found,
            lambda m, k: F.struct(
                F.lit(kind).alias("kind"),
                k.alias("k"),
                F.length(F.get(pieces, k)).alias("gap"),
                F.length(m).alias("size"),
                F.get(secrets, k).alias("secret"),
                (F.length(F.get(secrets, k)) >= least).alias("fits"),
            ),
        )

    def located(found: Column) -> Column:
        secrets = F.regexp_extract_all(text, F.lit(expression), F.lit(group)) if group else found
        return F.when(F.size(found) == 0, empty).otherwise(
            let(lambda s, p: parts(found, s, p), secrets, F.split(text, expression, -1))
        )

    return let(located, whole)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row_key, text_hash, copied, kind, secret, start, end) of every match that is long enough.

    Places are sums of the pieces before; only matches are shuffled, by document and kind.  Repeated rows give the
    same candidates once for each of their sources.  ``copied`` tells that equal texts are copies of one document.
    """
    text = whole_text()
    copied = F.col("text").rlike(rf"^\s*(?:\S+\s+){{{COPY_WORDS - 1}}}\S").alias("copied")
    found = docs.select(
        F.col("doc_id"), "source", text.alias("text"), *_key(text)
    ).select("doc_id", "source", *KEY, copied, F.explode(F.concat(*(matches(F.col("text"), rule) for rule in RULES))).alias("m"))
    found = found.select("doc_id", "source", *KEY, "copied", "m.*").dropDuplicates([*KEY, "source", "kind", "k"])
    before = Window.partitionBy(*KEY, "source", "kind").orderBy("k")
    end = F.sum(F.col("gap") + F.col("size")).over(before).cast("int")
    return (
        found.withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("size"))
        .where("fits")
        .select("doc_id", "source", *KEY, "copied", "kind", "secret", "start", "end")
    )


def ownership(found: DataFrame, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """(secret_hash, n_docs, n_owners, live) over the whole corpus; a null source is an owner of its own.

    Copies of a text are one document of one owner, the first by name.  An example needs ``wide_owners`` of both.
    Counted in two steps, by (secret, document, owner) and so on, each with partial sums before its shuffle.
    """
    text = F.when(F.col("copied"), F.col("text_hash")).otherwise(F.col("row_key")).alias("repository")
    hashed = found.select(F.sha2("secret", 256).alias("secret_hash"), text, "copied", "source")
    own = F.when(~F.col("copied"), F.col("source")).alias("own")
    held = hashed.groupBy("secret_hash", "repository", "copied", own).agg(F.min("source").alias("source"))
    held = stored(held.select("secret_hash", "repository", "source"), "secret-holders")
    counts = [
        held.select("secret_hash", column).distinct().groupBy("secret_hash").agg(F.count("*").alias(name))
        for column, name in (("repository", "n_docs"), ("source", "n_owners"))
    ]
    live = F.least("n_docs", "n_owners") < wide_owners
    return counts[0].join(counts[1], "secret_hash").withColumn("live", live)


def judged(docs: DataFrame, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """The candidates with what their secret's ownership says (n_docs, n_owners, live)."""
    found = stored(candidates(docs), "secret-candidates").withColumn("secret_hash", F.sha2("secret", 256))
    return attach(found, stored(ownership(found, wide_owners), "secret-owners"), ["secret_hash"])


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(kind) for kind, *_ in RULES))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.place), s.start.cast("string"), s.end.cast("string"))), ","
    )


def scan(docs: DataFrame, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, held), one row for each row of ``docs``.

    ``spans`` has the base spans and the live-looking ones of the looser rules, by start, then kind.  ``n_live`` and
    ``n_example`` count the listed spans by ownership, and ``held`` has, for each in turn, ``documents:owners`` that hold
    its secret.  A null text counts as empty.  Repeated rows are returned as
    often and alike, and count once; null ids are allowed.  Other columns are ignored; an empty table gives an empty
    result.
    """
    places = F.create_map(*(F.lit(x) for pair in _PLACE.items() for x in pair))
    listed = judged(docs, wide_owners).withColumn("place", places[F.col("kind")]).where(
        (F.col("place") < len(BASE)) | F.col("live")
    )
    listed = listed.dropDuplicates([*KEY, "place", "start"])
    span = F.struct("start", "place", "end", "n_docs", "n_owners")
    per_doc = listed.groupBy(*KEY).agg(
        *(F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind, *_ in BASE),
        F.sort_array(F.collect_list(span)).alias("all"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    rows = docs.select("doc_id", *_key(whole_text()))
    numbers = [f"n_{kind}" for kind, *_ in BASE]
    joined = attach(rows, stored(per_doc, "secret-spans"), KEY)
    whole = F.coalesce("all", F.array())
    base = F.filter(whole, lambda s: s.place < len(BASE))
    return joined.select(
        "doc_id",
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(whole).alias("spans"),
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_live", "n_example")),
        F.array_join(F.transform(whole, lambda s: F.concat_ws(":", s.n_docs.cast("string"), s.n_owners.cast("string"))), ",").alias("held"),
    )


def _cut_out(text: Column, spans: Column, mask: str) -> Column:
    """The text with sorted spans (start, end) replaced; those that overlap or touch become one mask."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def merge(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last.start.alias("start"), F.greatest(last.end, span.end).alias("end"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))
        alone = F.concat(done, F.array(F.struct(span.start.alias("start"), span.end.alias("end"))))
        return F.when(F.size(done) == 0, alone).otherwise(F.when(span.start <= last.end, joined).otherwise(alone))

    def rest(merged: Column) -> Column:
        before = F.transform(
            merged,
            lambda s, k: let(
                lambda at: F.substring(text, at + 1, s.start - at),
                F.when(k == 0, F.lit(0)).otherwise(F.get(merged, k - 1).end),
            ),
        )
        behind = F.substring(text, F.element_at(merged, -1).end + 1, F.length(text))
        return F.array_join(F.concat(before, F.array(behind)), mask)

    return let(rest, F.aggregate(spans, empty, merge))


def mask_live(docs: DataFrame, wide_owners: int = WIDE_OWNERS, mask: str = MASK) -> DataFrame:
    """``docs`` with every live-looking secret replaced by ``mask``; examples stay, and so do all documents.

    A secret is cut out where a rule found it, and nowhere else; secrets that overlap become one mask.  ``n_chars``, if
    there, is counted anew.  Null and empty texts stay as they are, repeated rows are masked alike, and all columns
    are kept; an empty table gives an empty one.
    """
    # the secret of an assignment ends the match, that of an address is followed by its at sign
    end = F.col("end") - F.when(F.col("kind") == "userinfo", 1).otherwise(0)
    span = F.struct((end - F.length("secret")).cast("int").alias("start"), end.cast("int").alias("end"))
    live = judged(docs, wide_owners).where("live").groupBy(*KEY).agg(F.sort_array(F.collect_set(span)).alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text")).select(
        "row", *_key(whole_text())
    )
    joined = attach(rows, stored(live, "secret-live"), KEY)
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(_cut_out(F.col("row.text"), F.col("spans"), mask))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(
            dict(docs.dtypes)["n_chars"]
        )
    return joined.select(*(new.get(n, F.col("row").getField(n)).alias(n) for n in docs.columns))
