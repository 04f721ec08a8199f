"""Collocations from an FM-index per shard over word ids.

The texts are read in shards of one language and bounded size, wherever they lie.  Each has a bidirectional FM-index:
the Burrows-Wheeler transforms of its words and of its words reversed, with the places of each word in them.  Suffixes
are sorted by as many words as a phrase can have, all that intervals of that depth need.  A phrase is a pair of intervals; the words
in one transform's interval are its extensions on one side, with their counts, and the other interval is narrowed along.

Counts are summed across shards depth by depth: words, pairs of frequent words, then phrases a word longer both of whose
parts may be frequent.  A phrase is no more frequent than its parts, so nothing with enough occurrences is lost.  Shards
hand over their phrases in packed blocks, dealt by hash; one task sums a block of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, discard, numbered, stored, whole_text

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2_000
#: A phrase goes if a longer one has so many hundredths of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: A shard is closed at so many words; a longer text is cut between pieces at about so many bytes.
SHARD_WORDS, SLICE_BYTES = 2_000_000, 4 << 20
#: Rows that a task hands over at once.
BATCH_ROWS = 1 << 16
#: Phrases of all shards that one task sums, about.
PART_GRAMS = 1_000_000
#: The filter of frequent phrases has 16 bits for each, and no more than so many altogether.
FILTER_BITS = 1 << 26
UNKNOWN = "und"

_BREAKS = frozenset(b".,;:!?\n\v\f\r")
#: No byte of UTF-8: it stands between pieces.
_BREAK = b"\xff"
_FOLD = bytes(255 if b in _BREAKS else b + 32 if 65 <= b <= 90 else b for b in range(256))

SHARDS = "lang string, n_words long, seq binary, held array<struct<place:int,word:string,n:long>>"
CODED = "gids binary, seq binary"


def slices(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A folded text, cut behind breaks."""
    start = 0
    while len(data) - start > size:
        end = data.find(_BREAK, start + size) + 1
        if not end:
            break
        yield data[start:end]
        start = end
    yield data[start:]


class _Shard:
    """Words of one language read so far, numbered from 1 as they come; 0 stands between pieces and texts."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {_BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        numbers = self.numbers
        for word in set(words).difference(numbers):
            numbers[word] = len(numbers)
        part = np.zeros(len(words) + 1, np.int32)
        part[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        self.parts.append(part)
        self.size += len(words)

    def row(self, lang: str) -> dict:
        seq = np.concatenate(self.parts)
        counts = np.bincount(seq, minlength=len(self.numbers))
        counts[0] = 0
        held = {"place": np.arange(1, len(counts)), "n": counts[1:]}
        words = pa.array([w for w in self.numbers if w != _BREAK], pa.binary()).cast(pa.string())
        held = pa.StructArray.from_arrays([pa.array(held["place"], pa.int32()), words, pa.array(held["n"], pa.int64())], ["place", "word", "n"])
        return {"lang": lang, "n_words": int(counts.sum()), "seq": pack(seq), "held": held}


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, byte by byte (the lowest bytes of all, then the next ones), and compressed."""
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T) for c in columns]
    kept = [p[: int(np.flatnonzero(p.any(axis=1))[-1]) + 1] if p.any() else p[:0] for p in planes]
    head = np.array([len(columns), len(columns[0]), *map(len, kept)], "<i8").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in kept))


def unpack(data: bytes) -> list[np.ndarray]:
    count, size = np.frombuffer(data[:16], "<i8").tolist()
    widths = np.frombuffer(data[16 : 16 + 8 * count], "<i8").tolist()
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16 + 8 * count :], max_output_size=size * sum(widths) or 1), np.uint8)
    out, at = [], 0
    for width in widths:
        planes = np.zeros((8, size), np.uint8)
        planes[:width] = raw[at : at + width * size].reshape(width, size)
        at += width * size
        out.append(np.ascontiguousarray(planes.T).view("<i8").ravel())
    return out


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    open_shards: dict[str, _Shard] = {}

    def closed() -> Iterator[pa.RecordBatch]:
        for lang, shard in open_shards.items():
            row = shard.row(lang)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["lang"]], pa.string()),
                    pa.array([row["n_words"]], pa.int64()),
                    pa.array([row["seq"]], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(row["held"])], pa.int32()), row["held"]),
                ],
                ["lang", "n_words", "seq", "held"],
            )
        open_shards.clear()

    total = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            for part in slices(text.as_py().translate(_FOLD)):
                words = part.replace(_BREAK, b" \xff ").split()
                if words:
                    open_shards.setdefault(lang, _Shard()).add(words)
                    total += len(words)
                if total >= shard_words:
                    yield from closed()
                    total = 0
    yield from closed()


class Side:
    """One direction: the suffixes sorted by their first ``depth`` words, the word before each, and its places."""

    def __init__(self, seq: np.ndarray, depth: int):
        n, rank, width = len(seq), seq.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width < depth:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, np.diff(key[order]) != 0])
            width *= 2
        self.n = n
        self.before = seq[order - 1].astype(np.int32)
        #: (word, row) of the transform in order: how many lie below a given one is the rank that narrows an interval
        self.places = self.before.astype(np.int64) * n
        self.places += np.arange(n)
        self.places.sort()

    def extensions(self, low: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of intervals (low, size) here and from ``other`` in the other direction, all extensions by a word.

        Returns (interval, word, low here, size, low there), by interval and word; word 0 is left out.
        """
        rows = np.arange(int(size.sum()))
        rows += np.repeat(low - (np.cumsum(size) - size), size)
        width = int(self.before.max()) + 1
        key = np.repeat(np.arange(len(low)) * width, size)
        key += self.before[rows]
        del rows
        key, counts = np.unique(key, return_counts=True)
        which, word = key // width, key % width
        ahead = np.cumsum(counts) - counts
        first = np.diff(which, prepend=-1) != 0
        there = other[which] + ahead - ahead[first][np.cumsum(first) - 1]
        here = np.searchsorted(self.places, word * self.n + low[which])
        some = word > 0
        return which[some], word[some], here[some], counts[some], there[some]


class ShardIndex:
    """The bidirectional index of one shard; phrases are columns of word ids with their intervals."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.forward, self.backward = Side(seq, depth), Side(seq[::-1], depth)
        counts = np.bincount(seq)
        self.words = np.flatnonzero(counts[1:]) + 1
        self.size = counts[self.words]
        self.low = self.there = (np.cumsum(counts) - counts)[self.words]
        self.columns = [self.words]

    def extend(self, left: bool, keep) -> None:
        """Extend all phrases by a word on one side; ``keep`` tells which of the longer ones (as columns) may stay."""
        side, low, other = (self.forward, self.low, self.there) if left else (self.backward, self.there, self.low)
        which, word, here, size, there = side.extensions(low, self.size, other)
        columns = [c[which] for c in self.columns]
        columns = [word, *columns] if left else [*columns, word]
        some = keep(columns)
        self.columns, self.size = [c[some] for c in columns], size[some]
        self.low, self.there = (here[some], there[some]) if left else (there[some], here[some])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's words numbered anew by their corpus-wide number; breaks and rare words become single zeros."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.column("known")[k].values
            place, gid = (row.field(c).to_numpy().astype(np.int64) for c in ("place", "gid"))
            seq = unpack(batch.column("seq")[k].as_py())[0]
            order = np.argsort(gid)
            fresh = np.zeros(int(seq.max()) + 1, np.int64)
            fresh[place[order]] = np.arange(1, len(order) + 1)
            seq = fresh[seq]
            seq = seq[(seq > 0) | (np.r_[0, seq[:-1]] > 0)]
            yield pa.RecordBatch.from_pydict(
                {"gids": pa.array([gid[order].tobytes()], pa.binary()), "seq": pa.array([pack(seq)], pa.binary())}
            )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(corpus-wide numbers by local number, sequence with a zero at its end)."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield np.r_[-1, np.frombuffer(batch.column("gids")[k].as_py(), np.int64)], np.r_[unpack(batch.column("seq")[k].as_py())[0], 0]


def _dealt(columns: list[np.ndarray], n: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, grams): the phrases of a shard with their counts, dealt by hash and packed as differences, in order."""
    mixed = np.full(len(n), 0x9E3779B97F4A7C15, np.uint64)
    for place, column in enumerate(columns):
        # neighbours in the last column stay together, so that differences are small
        value = column if place < len(columns) - 1 else column >> 8
        mixed = (mixed ^ value.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    part = (mixed % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((*columns[::-1], part))
    part, columns, n = part[order], [c[order] for c in columns], n[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    rows: list[tuple[int, bytes]] = []
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(n)]):
        deltas = [np.diff(c[start:end], prepend=0) for c in columns]
        # the sign goes to the lowest bit
        rows.append((int(part[start]), pack(*((d << 1) ^ (d >> 63) for d in deltas), n[start:end])))
    for start in range(0, len(rows), BATCH_ROWS):
        some = rows[start : start + BATCH_ROWS]
        yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in some], pa.int64()), "grams": pa.array([g for _, g in some], pa.binary())})


def _summed(group: pa.Table, names: list[str], min_count: int) -> pa.Table:
    """The frequent phrases of one part, summed over all shards."""
    found = [unpack(data) for data in group.column("grams").to_pylist()]
    columns = [np.concatenate([np.cumsum((f[k] >> 1) ^ -(f[k] & 1)) for f in found]) for k in range(len(names))]
    n = np.concatenate([f[-1] for f in found])
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    first = np.zeros(len(n), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(first)
    total = np.add.reduceat(n, starts)
    kept = total >= min_count
    return pa.table([pa.array(c[starts][kept], pa.int64()) for c in columns] + [pa.array(total[kept], pa.int64())], [*names, "f"])


def _summing(names: list[str], min_count: int):
    def summed(group: pa.Table) -> pa.Table:
        return _summed(group, names, min_count)

    return summed


def _pairs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for gids, seq in _read(batches):
        index = Side(seq, 2)
        counts = np.bincount(seq)
        words = np.flatnonzero(counts)[1:]
        low = (np.cumsum(counts) - counts)[words]
        which, word, _, size, _ = index.extensions(low, counts[words], low)
        yield from _dealt([gids[word], gids[words[which]]], size, parts)


def gram_bits(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """The bit that a phrase of corpus-wide numbers has in a filter of ``bits`` (a power of two)."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        mixed = (mixed + column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) & np.uint64(bits - 1)


def gram_filter(grams: DataFrame, names: list[str], most: int = FILTER_BITS) -> np.ndarray:
    """Bits of all phrases of a stored table, as bytes: a filter that lets each of them pass and few others.

    Its size is bounded; a fuller one lets more pass, which are then counted for nothing.
    """
    bits = 1 << 16
    wanted = 16 * grams.count()
    while bits < min(wanted, most):
        bits *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(bits, bool)
        for batch in batches:
            marked[gram_bits([batch.column(c).to_numpy() for c in names], bits)] = True
        packed = np.packbits(marked, bitorder="little").view(np.int64)
        some = np.flatnonzero(packed)
        yield pa.RecordBatch.from_pydict({"at": some.astype(np.int64), "word": packed[some]})

    found = grams.select(*names).mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    table = found.toArrow()  # at most ``most`` / 64 rows
    packed = np.zeros(bits // 64, np.int64)
    packed[table.column("at").to_numpy()] = table.column("word").to_numpy()
    return packed.view(np.uint8)


def _longer(batches: Iterator[pa.RecordBatch], filters, parts: int) -> Iterator[pa.RecordBatch]:
    """Phrases a word longer than those of the last filter, both of whose parts pass."""
    packed = [f.value for f in filters]

    def passes(grams: list[np.ndarray]) -> np.ndarray:
        bits = packed[len(grams) - 2]
        bit = gram_bits(grams, 8 * len(bits))
        return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    for gids, seq in _read(batches):
        index = ShardIndex(seq, len(filters) + 2)
        for depth in range(2, len(filters) + 3):

            def keep(grams: list[np.ndarray], depth: int = depth, gids: np.ndarray = gids) -> np.ndarray:
                names = [gids[g] for g in grams]
                if depth == 2:
                    return passes(names)
                return passes(names[1:]) & passes(names[:-1])

            index.extend(depth % 2 == 0, keep)
        yield from _dealt([gids[c] for c in index.columns], index.size, parts)


def _decimal(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def count_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables (key, len, f) of all phrases with ``min_count`` occurrences, (gid, lang, word, n), (lang, n).

    ``key`` holds the corpus-wide numbers of the words, joined by spaces; a number belongs to one language.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), whole_text().alias("text"))
    shards = rows.mapInArrow(lambda batches: _shards(batches, shard_words), SHARDS)
    shards = stored(shards.withColumn("shard", F.monotonically_increasing_id()), "phrase-shards")
    totals = stored(shards.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    held = shards.select("shard", "lang", F.inline("held"))
    words = held.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    words = stored(numbered(words, [F.desc("n"), F.col("lang"), F.col("word")], "gid"), "phrase-words")
    known = attach(held, words.select("lang", "word", "gid"), ["lang", "word"], "inner")
    known = known.groupBy("shard").agg(F.collect_list(F.struct("place", "gid")).alias("known"))
    # a shard's words stay where they are gathered, and its sequence comes there, whatever the size of either
    coded = shards.select("shard", "seq").hint("merge").join(known, "shard")
    coded = stored(coded.select("known", "seq").mapInArrow(_code, CODED), "phrase-coded")
    discard(shards)
    # a shard has no more phrases of a length than words
    parts = max(1, (totals.agg(F.sum("n")).first()[0] or 0) // PART_GRAMS)
    phrases = words.select(F.col("gid").cast("string").alias("key"), F.lit(1).alias("len"), F.col("n").alias("f"))
    filters = []
    for size in range(2, max_words + 1):
        names = [f"w{k + 1}" for k in range(size)]
        schema = ", ".join(f"{name} long" for name in names) + ", f long"
        work = (lambda b: _pairs(b, parts)) if size == 2 else (lambda b, f=tuple(filters): _longer(b, f, parts))
        dealt = coded.mapInArrow(work, "part long, grams binary")
        frequent = dealt.groupBy("part").applyInArrow(_summing(names, min_count), schema)
        frequent = stored(frequent, "phrase-grams")
        phrases = phrases.unionByName(frequent.select(F.concat_ws(" ", *names).alias("key"), F.lit(size).alias("len"), "f"))
        if size < max_words:
            filters.append(docs.sparkSession.sparkContext.broadcast(gram_filter(frequent, names)))  # bounded by FILTER_BITS
    phrases = stored(phrases, "phrase-counts")
    discard(coded)
    for shared in filters:
        shared.destroy()
    return phrases, words, totals


def mine_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, most_left, most_right): each language's ``top`` collocations.

    ``docs`` has text and lang; a null lang is ``und``, a null or empty text has no words.  ``a`` is the number of
    occurrences, ``l`` and ``r`` those of the parts at the lowest-scoring cut, ``n`` the language's words.  The last two
    are the occurrences of the most frequent extension by a word on either side, 0 below ``min_count``.  Ties go by
    occurrences, then by the phrase's bytes; repeated rows each count.  Other columns are ignored; an empty table, or
    a language without frequent phrases, gives no row.
    """
    phrases, words, totals = count_phrases(docs, min_count, max_words, shard_words)
    candidates = phrases.where("len > 1").withColumnRenamed("f", "a")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(key, ' ', k)"), "right": F.expr("substring_index(key, ' ', k - len)")})
    cuts = attach(cuts, phrases.select(F.col("key").alias("left"), F.col("f").alias("l")), ["left"])
    cuts = attach(cuts, phrases.select(F.col("key").alias("right"), F.col("f").alias("r")), ["right"])
    score = F.expr(
        f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"
    )
    scored = cuts.withColumn("score", score).groupBy("key", "len", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    ends = F.array(
        F.struct(F.expr("substring_index(key, ' ', len - 1)").alias("key"), F.lit(False).alias("on_left")),
        F.struct(F.expr("substring_index(key, ' ', 1 - len)").alias("key"), F.lit(True).alias("on_left")),
    )
    # an extension by two words implies one by one word that is at least as frequent
    around = candidates.where("len > 2").select("a", F.inline(ends)).groupBy("key").agg(
        F.max(F.when(F.col("on_left"), F.col("a"))).alias("most_left"), F.max(F.when(~F.col("on_left"), F.col("a"))).alias("most_right")
    )
    scored = attach(scored, stored(around, "phrase-around"), ["key"])
    scored = scored.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("most_left", "most_right")})
    scored = stored(
        scored.where(100 * _decimal(F.greatest("most_left", "most_right")) < COVERED * _decimal(F.col("a"))), "phrase-scores"
    )
    spelled = scored.select("key", F.posexplode(F.split("key", " ")).alias("place", "gid")).withColumn("gid", F.col("gid").cast("long"))
    spelled = attach(spelled, words.select("gid", "lang", "word"), ["gid"], "inner").groupBy("key").agg(
        F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("parts")
    )
    spelled = spelled.select("key", "lang", F.array_join(F.col("parts.word"), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = (
        scored.join(spelled, "key")
        .select("lang", "phrase", "a", "s.l", "s.r", "s.score", "most_left", "most_right")
        .withColumn("rank", rank)
        .where(F.col("rank") <= top)
    )
    return attach(ranked, totals, ["lang"]).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "most_left", "most_right"
    )


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i : i + len - 1], ' '))) AS phrase
  FROM said, (VALUES (1), (2), (3), (4)) AS lengths(len) WHERE len(w) >= len),
counts AS MATERIALIZED (SELECT lang, len, phrase, lang || chr(9) || phrase AS name, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE len = 1 GROUP BY lang),
candidates AS MATERIALIZED (
  SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE len > 1 AND f >= 30),
cuts AS MATERIALIZED (
  SELECT lang, phrase, len, a, k, lang || chr(9) || array_to_string(w[1 : k], ' ') AS first_part,
    lang || chr(9) || array_to_string(w[k + 1 : len], ' ') AS rest
  FROM candidates, (VALUES (1), (2), (3)) AS cut(k) WHERE k < len),
halves AS MATERIALIZED (SELECT cuts.*, f AS l FROM cuts JOIN counts ON name = first_part),
scored AS (
  SELECT halves.lang, halves.phrase, halves.len, a, k, l, f AS r, 2000000::HUGEINT * a // (l + f) AS score FROM halves JOIN counts ON name = rest
  QUALIFY row_number() OVER (PARTITION BY halves.lang, halves.phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, a, i = 1 AND size = len - 1 AS at_start, i = 2 AND size = len - 1 AS at_end
  FROM candidates, (VALUES (2), (3)) AS sizes(size), (VALUES (1), (2), (3)) AS starts(i) WHERE size < len AND i + size - 1 <= len),
around AS (
  SELECT lang, phrase, max(a) AS most, max(a) FILTER (at_end) AS most_left, max(a) FILTER (at_start) AS most_right
  FROM parts GROUP BY lang, phrase),
kept AS (
  SELECT s.*, coalesce(most_left, 0) AS most_left, coalesce(most_right, 0) AS most_right
  FROM scored s LEFT JOIN around USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score, most_left, most_right
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
