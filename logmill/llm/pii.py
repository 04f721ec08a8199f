"""Personal data by rules and by bootstrapped context.

The rules find e-mail and IP addresses, card and phone numbers.  These seeds induce lexical patterns: the one to three
words before them, or what is glued to their front (``tel:``).  Spark scores the graph of patterns and instances in
turns: a pattern is as good as the share of all its occurrences, whatever follows, that are trusted, an instance as good
as its best pattern.  Instances that a turn trusts support patterns in the next.  Patterns that end with high confidence
and enough different seeds then mark the identifier-like tokens behind them that no rule knows (kind ``context``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stored, whole_text

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
ROUNDS = 3
#: A pattern counts with so many different seeds or trusted instances, and marks at such a confidence.
SUPPORT = 5
CONFIDENCE = 0.9
#: Longer words make no pattern; a pattern has so many words at most.
WORD_LENGTH = 40
WORDS = 3
#: Patterns that a pass over the texts counts.
PATTERNS = 200_000
#: Tokens whose forms a counting task keeps.
MEMO_TOKENS = 200_000

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_FRONT = re.compile(r"^[\W_]+")
_GLUE = re.compile(r"[^:=]*[^\W_][^:=]*[:=]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

SCANNED = (
    "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "found array<struct<patterns:array<string>,value:string,seed:boolean,start:int,end:int>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(map(int, reversed(digits))):
        total += digit if k % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from at sign to at sign, so that words without one cost nothing."""
    low, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while domain and start > low and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            low = domain.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order, in code points."""
    cards, phones = [], []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            phones.append(m.span())
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.groups())]
    return {"email": list(_emails(text)), "ip": ips, "card": cards, "phone": phones}


def form(token: str) -> str:
    """A token as patterns have it: lower-cased, without marks but a last ``:``, ``=`` or ``#``; empty if too long."""
    if len(token) > 4 * WORD_LENGTH:
        return ""
    core = _EDGES.sub("", token.lower())
    last = token[-1] if core and token[-1] in ":=#" else ""
    return core + last if len(core) <= WORD_LENGTH else ""


def glue(token: str) -> str:
    """What a token begins with, up to its first ``:`` or ``=``, if that holds a letter or digit; else empty."""
    found = _GLUE.match(token, 0, WORD_LENGTH)
    return _FRONT.sub("", found[0].lower()) + "~" if found and found.end() < len(token) else ""


def patterns_before(text: str, start: int) -> list[str]:
    """The patterns that lead to ``start``: one to three words, or the glued front of its token alone."""
    before = text[max(0, start - 4 * WORD_LENGTH * WORDS) : start]
    words = before.split()
    if before and not before[-1].isspace():  # marks, or something glued
        front = words.pop()
        if _EDGES.sub("", front):
            return [glue(front + "0")] if len(front) <= WORD_LENGTH and _GLUE.fullmatch(front) else []
    out: list[str] = []
    for word in words[: -WORDS - 1 : -1]:
        known = form(word)
        if not known:
            break
        out.append(f"{known} {out[-1]}" if out else known)
    return out


def other_tokens(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens outside the spans: 5 or more characters between marks, 3 or more of them digits.

    A front without digits that ends with ``:`` or ``=`` is not part of it.
    """
    taken, k, done = sorted(taken), 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        low = max(text.rfind(c, done, m.start()) for c in " \t\n\v\f\r") + 1
        start, space = max(low, done), _SPACE.search(text, m.end())
        done = end = space.start() if space else len(text)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        core = _EDGES.sub("", text[start:end])
        if len(core) < 5 or sum(c.isdigit() for c in core) < 3 or (k < len(taken) and taken[k][0] < end):
            continue
        at = text.index(core, start)
        front = _GLUE.match(core, 0, WORD_LENGTH)
        if front and not _DIGITS.search(front[0]):
            rest = _EDGES.sub("", core[front.end() :])
            if len(rest) >= 5:
                at, core = text.index(rest, at + front.end()), rest
        yield at, at + len(core)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct(
        [("patterns", pa.list_(pa.string())), ("value", pa.string()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]
    )
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, strings, found = [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            for k in KINDS:
                counts[k].append(len(spans[k]))
            strings.append(",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]))
            digests.append(hashlib.sha256(strings[-1].encode()).hexdigest())
            flat = [span for k in KINDS for span in spans[k]]
            marked = [(a, b, True) for a, b in flat] + [(a, b, False) for a, b in other_tokens(text, flat)]
            rows = []
            for a, b, seed in marked:
                rows.append({"patterns": patterns_before(text, a), "value": text[a:b], "seed": seed, "start": a, "end": b})
            found.append(rows)
        columns = {c: batch.column(c) for c in ("doc_id", "text_hash")}
        columns |= {f"n_{k}": pa.array(counts[k], pa.int64()) for k in KINDS}
        columns |= {"base_sha256": pa.array(digests, pa.string()), "base": pa.array(strings, pa.string())}
        columns["found"] = pa.array(found, pa.list_(kind))
        yield pa.RecordBatch.from_pydict(columns)


class PatternCounter:
    """Occurrences of given patterns before a further token, whatever that is, and of glued ones before anything."""

    def __init__(self, patterns: list[str], memo_tokens: int = MEMO_TOKENS):
        self.glued = {p: k for k, p in enumerate(patterns) if p.endswith("~")}
        worded = [(p.split(" "), k) for k, p in enumerate(patterns) if not p.endswith("~")]
        self.forms = {f: k + 1 for k, f in enumerate(sorted({f for words, _ in worded for f in words}))}
        self.base = len(self.forms) + 1
        self.keys, self.places = [], []
        for size in range(1, WORDS + 1):
            known = sorted((self._key([self.forms[f] for f in words]), k) for words, k in worded if len(words) == size)
            self.keys.append(np.array([key for key, _ in known], np.int64))
            self.places.append(np.array([k for _, k in known], np.int64))
        self.counts = np.zeros(len(patterns), np.int64)
        self.memo_tokens, self.memo = memo_tokens, {}

    def _key(self, numbers):
        key = 0
        for number in numbers:
            key = key * self.base + number
        return key

    def _learn(self, tokens: set[str]) -> None:
        if len(self.memo) + len(tokens) > self.memo_tokens:
            self.memo = {}
        for token in tokens.difference(self.memo):
            glued = self.glued.get(glue(token)) if ":" in token or "=" in token else None
            number = self.forms.get(form(token), 0)
            self.memo[token] = number if glued is None else number + self.base * (glued + 1)

    def add(self, texts: list[str]) -> None:
        split = [text.split() for text in texts]
        tokens = set().union(*split)
        self._learn(tokens)
        lookup = self.memo.__getitem__
        size = sum(map(len, split)) + len(split)
        # a zero ends each text, and its last token stands before none
        found, at = np.zeros(size, np.int64), 0
        for words in split:
            found[at : at + len(words)] = np.fromiter(map(lookup, words), np.int64, len(words))
            if words:
                found[at + len(words) - 1] = found[at + len(words) - 1] // self.base * self.base
            at += len(words) + 1
        glued, found = np.divmod(found, self.base)
        if self.glued:
            self.counts += np.bincount(glued, minlength=len(self.counts) + 1)[1:]
        for size, (keys, places) in enumerate(zip(self.keys, self.places), 1):
            ends = np.flatnonzero(found[size - 1 :]) + size - 1
            if not len(keys) or not len(ends):
                continue
            parts = [found[ends - k] for k in range(size - 1, -1, -1)]
            key = self._key(parts)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            # a zero among the words gives another key
            hit = (keys[at] == key) & np.all(parts, axis=0)
            self.counts += np.bincount(places[at[hit]], minlength=len(self.counts))


def _occurrences(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(pattern, n) of the wanted patterns over a partition."""
    counter = PatternCounter(shared.value)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for start in range(0, len(texts), 500):
            counter.add(texts[start : start + 500])
    yield pa.RecordBatch.from_pydict({"pattern": pa.array(shared.value, pa.string()), "n": pa.array(counter.counts, pa.int64())})


def pattern_totals(texts: DataFrame, patterns: DataFrame, at_once: int = PATTERNS) -> DataFrame:
    """(pattern, total): all occurrences of the stored ``patterns`` in the texts, which are read once per block of them."""
    spark = texts.sparkSession
    total = spark.createDataFrame([], "pattern string, total long")
    blocks = -(-patterns.count() // at_once)
    for block in range(blocks):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).select("pattern")
        shared = spark.sparkContext.broadcast([r.pattern for r in part.collect()])  # about ``at_once`` short strings
        found = texts.mapInArrow(lambda batches, s=shared: _occurrences(batches, s), "pattern string, n long")
        total = total.unionByName(stored(found.groupBy("pattern").agg(F.sum("n").alias("total")), "pii-totals"))
        shared.destroy()
    return total


def confident_patterns(
    found: DataFrame, texts: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE
) -> DataFrame:
    """(pattern, confidence) of the bootstrapped patterns.  ``found``: one row per seed or candidate of ``texts``.

    Only patterns with enough different instances can ever count; what else follows these is counted in the texts.
    The graph has one edge per pattern and instance, counted before it is shuffled, so that a frequent word is no
    hot group of occurrences.
    """
    edges = stored(
        found.select(F.explode("patterns").alias("pattern"), "value", "seed")
        .groupBy("pattern", "value")
        .agg(F.count("*").alias("n"), F.max("seed").alias("seed")),
        "pii-edges",
    )
    able = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("led"))
    able = stored(able.where(F.col("values") >= support).select("pattern", "led"), "pii-able")
    # what a pattern leads to may be the last token in parts (a span behind marks), so it is no less than that
    totals = attach(able, pattern_totals(texts, able), ["pattern"]).select("pattern", F.greatest("led", "total").alias("total"))
    edges = stored(attach(edges, stored(totals, "pii-totals"), ["pattern"], "inner"), "pii-able-edges")
    trust = stored(edges.groupBy("value").agg(F.max("seed").cast("double").alias("trust")), "pii-trust")
    scored = None
    for _ in range(rounds):
        scored = stored(
            attach(edges, trust, ["value"])
            .groupBy("pattern")
            .agg(
                (F.sum(F.when(F.col("trust") >= confidence, F.col("n")).otherwise(0)) / F.max("total")).alias("confidence"),
                F.count_if(F.col("trust") >= confidence).alias("trusted"),
            )
            .where(F.col("trusted") >= support),
            "pii-patterns",
        )
        best = attach(edges, scored.select("pattern", "confidence"), ["pattern"]).groupBy("value").agg(
            F.when(F.max("seed"), F.lit(1.0)).otherwise(F.coalesce(F.max("confidence"), F.lit(0.0))).alias("trust")
        )
        trust = stored(best, "pii-trust")
    return scored.where(F.col("confidence") >= confidence).select("pattern", "confidence")


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context), one row for each row of ``docs``.

    ``spans`` lists the base spans by kind and start, then the added ones of kind ``context`` by start.  A null text
    counts as empty.  Rows that share an id, null or not, are told apart by their text; repeated rows are returned as
    often and alike, and each counts as evidence.  Other columns are ignored; an empty table gives an empty result.
    """
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    scanned = stored(rows.mapInArrow(_scan, SCANNED), "pii-scanned")
    found = scanned.select("doc_id", "text_hash", F.inline("found"))
    good = stored(confident_patterns(found, rows.select("text"), **options), "pii-confident")
    candidates = found.where("not seed").select(
        "doc_id", "text_hash", "start", "end", F.explode("patterns").alias("pattern")
    )
    added = (
        attach(candidates, good, ["pattern"], "inner")
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("added"))
    )
    added = stored(added, "pii-added")
    same = scanned.doc_id.eqNullSafe(added.doc_id) & (scanned.text_hash == added.text_hash)
    more = F.transform(F.coalesce(added.added, F.array()), lambda s: F.format_string(f"{CONTEXT}:%d:%d", s.start, s.end))
    whole = F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), more)
    return scanned.join(added, same, "left").select(
        scanned.doc_id,
        *(f"n_{k}" for k in KINDS),
        "base_sha256",
        F.array_join(whole, ",").alias("spans"),
        F.size(more).cast("long").alias("n_context"),
    )
