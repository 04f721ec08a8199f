"""Order MinHash: fingerprints that are sensitive to edit distance, in DataFrame functions only.

Words are taken ``k`` at a time; equal k-mers are told apart by their occurrence number.  A hash of (k-mer, occurrence)
puts each one into a bin; of every bin the ``picks`` smallest hashes are selected, put back into text order, and their
k-mers hashed as a tuple.  A fingerprint is the list of (bin, tuple hash); two texts are alike by the share of bins,
filled in either, with equal tuples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import numbered, stored, whole_text, words

K = 3
BINS = 64
PICKS = 2
#: Low bits of a packed number: a place in the text.
PLACE = 28
_MASK = (1 << PLACE) - 1
_HASH = 29


def kmer_hashes(text: Column, k: int = K) -> Column:
    """Hashes of the k-mers of words in text order; fewer words make one k-mer, none makes none."""
    return let(
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) <= k, F.array(F.xxhash64(w)))
        .otherwise(
            F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))
        ),
        words(text),
    )


def _occurrence(ordered: Column, j: Column, kmer: Column) -> Column:
    """How many equal k-mers stand before place ``j`` of the sorted list, by halving steps: they stand side by side."""

    def same(back: Column) -> Column:
        return F.shiftright(F.get(ordered, j - back), PLACE) == kmer

    steps = F.array(*(F.lit(1 << b) for b in range(PLACE - 1, -1, -1)))
    counted = F.aggregate(
        steps, F.lit(0), lambda n, step: F.when((j - n - step >= 0) & same(n + step), n + step).otherwise(n)
    )
    return F.when((j > 0) & same(F.lit(1)), counted).otherwise(F.lit(0))


def fingerprint(text: Column, k: int = K, bins: int = BINS, picks: int = PICKS) -> Column:
    """The fingerprint as an array of (bin << 32 | tuple hash), in order of bins; empty for a text without words."""
    by_bin = PLACE + _HASH

    def ranked(ordered: Column) -> Column:
        """(bin, hash of k-mer and occurrence, place), packed into one number."""

        def pack(x: Column, j: Column) -> Column:
            kmer = F.shiftright(x, PLACE)
            return let(
                lambda h: F.shiftleft(F.pmod(h, F.lit(bins)), by_bin)
                + F.shiftleft(F.shiftrightunsigned(h, 64 - _HASH), PLACE)
                + x.bitwiseAND(F.lit(_MASK)),
                F.xxhash64(kmer, _occurrence(ordered, j, kmer)),
            )

        return F.transform(ordered, pack)

    def tuples(hashes: Column, chosen: Column) -> Column:
        size = F.size(chosen)
        heads = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda j: (j == 0) | (F.shiftright(F.get(chosen, j), by_bin) != F.shiftright(F.get(chosen, j - 1), by_bin)),
        )

        def entry(j: Column) -> Column:
            bin_ = F.shiftright(F.get(chosen, j), by_bin)
            places = F.transform(
                F.filter(F.slice(chosen, j + 1, F.lit(picks)), lambda x: F.shiftright(x, by_bin) == bin_),
                lambda x: x.bitwiseAND(F.lit(_MASK)),
            )
            in_order = F.transform(F.sort_array(places), lambda p: F.get(hashes, p.cast("int")))
            return F.shiftleft(bin_, 32) + F.shiftrightunsigned(F.xxhash64(in_order), 32)

        return F.transform(heads, entry)

    def whole(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE) + i)
        found = let(lambda ordered: F.sort_array(ranked(ordered)), F.sort_array(placed))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(
            let(lambda chosen: tuples(hashes, chosen), found)
        )

    return let(whole, kmer_hashes(text, k))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the bins filled in either; 1 if neither has any."""
    bins = F.array_union(F.transform(a, lambda e: F.shiftright(e, 32)), F.transform(b, lambda e: F.shiftright(e, 32)))
    return F.when(F.size(bins) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(bins))


def as_string(entries: Column) -> Column:
    """Ten lowercase hex digits for each filled bin: its number, then the tuple hash."""
    return F.array_join(F.transform(entries, lambda e: F.lpad(F.lower(F.hex(e)), 10, "0")), "")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last quarter (rounded down) of the text's code points gives way to as many from the start of
    the next document in order of doc_id (null first; the first follows the last).  A null text counts as empty.  Of
    rows that share an id, one text is the next document of the row before: that with the smallest hash; all of
    them have the same next document.  Repeated rows are returned as often.  Other columns are ignored; an empty table
    gives an empty result.

    Texts are shuffled once, by id: the exchange serves to fetch the starts of next documents and to edit.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ids = rows.groupBy("doc_id").agg(
        (F.max(F.length("text")) / 4).cast("int").alias("quarter"), F.min(F.xxhash64("text")).alias("text_hash")
    )
    ids = stored(numbered(ids, [F.col("doc_id")], "row"), "omh-ids")
    total = ids.count()
    after = ids.select(
        F.pmod(F.col("row") - 1, F.lit(max(1, total))).alias("row"),
        F.col("doc_id").alias("next_id"),
        F.col("text_hash").alias("next_hash"),
    )
    wanted = stored(ids.select("row", "doc_id", "quarter").join(after, "row").drop("row"), "omh-next")

    source = rows.alias("s")
    # not an equi-key, so that the exchange of the texts is the same as in the join below
    right_text = F.xxhash64("s.text").bitwiseXOR(F.col("w.next_hash")) == 0
    starts = (
        source.join(wanted.alias("w"), F.col("s.doc_id").eqNullSafe(F.col("w.next_id")) & right_text)
        .select(F.col("w.doc_id").alias("doc_id"), F.substring("s.text", F.lit(1), F.col("w.quarter")).alias("start"))
        .dropDuplicates(["doc_id"])
    )
    n = F.length("t.text")
    quarter = (n / 4).cast("int")
    edited = F.concat(F.substring("t.text", F.lit(1), n - quarter), F.substring("n.start", F.lit(1), quarter))
    both = rows.alias("t").join(starts.alias("n"), F.col("t.doc_id").eqNullSafe(F.col("n.doc_id")))
    marked = both.select(
        F.col("t.doc_id").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.xxhash64("t.text").alias("text_hash"),
        F.sha2(edited, 256).alias("edited_sha256"),
        fingerprint(F.col("t.text")).alias("own"),
        fingerprint(edited).alias("edited"),
    )
    marked = stored(marked, "omh-fingerprints")
    other = marked.select("doc_id", "text_hash", F.col("own").alias("next")).dropDuplicates(["doc_id", "text_hash"])
    o, w, m = other.alias("o"), wanted.alias("w"), marked.alias("m")
    follow = o.join(w, F.col("o.doc_id").eqNullSafe(F.col("w.next_id")) & (F.col("o.text_hash") == F.col("w.next_hash")))
    follow = follow.select(F.col("w.doc_id").alias("doc_id"), "o.next").alias("f")
    return m.join(follow, F.col("m.doc_id").eqNullSafe(F.col("f.doc_id"))).select(
        "m.doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
