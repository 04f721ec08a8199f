"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, numbered, running_total, stored, whole_text, words

WEIGHTS = (3, 1, 2)
SEED = 20
HASH_BITS = 40
BLOCK_ROWS = 1_000


def cycled_weights(index: Column, weights: tuple[int, ...] = WEIGHTS) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), (index % len(weights)).cast("int") + 1)


def water_filled(sources: DataFrame, total: float) -> DataFrame:
    """Add ``target`` = min(cap, level * weight) to (weight, cap): the level at which the targets sum to ``total``.

    Each pass clamps what lies above its cap and shares the rest anew by weight; it reads two sums only.  If
    the caps do not reach the total, every source ends at its cap.
    """
    clamped, level = -1, 0.0
    over = F.lit(False)
    while True:
        row = sources.agg(
            F.count_if(over).alias("n"),
            F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("cap"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row.n == clamped or not row.weight:
            break
        clamped, level = row.n, max(0.0, (total - row.cap) / row.weight)
        over = F.col("weight") * F.lit(level) > F.col("cap")
    return sources.withColumn("target", F.when(over, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    max_epochs: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, text_hash, size, source_size, target, taken).

    Size is the number of words, 0 for a null text.  The sources in order of code points, null last, take the
    weights in turn.  Every document of a source is taken as often as whole repetitions fit into its target; the
    fractional repetition takes documents in the order of a seeded hash of (doc_id, text) until the target is met,
    the last of them in part.  Each row of a repeated row counts; which of them is taken in part is open.
    Null ids are ids of their own.  An empty table gives an empty result; other columns are ignored.

    A hot source is cut into blocks of about ``block_rows`` rows by its hash; only a block is sorted in one task.
    """
    text = whole_text()
    rows = stored(
        docs.select(
            "doc_id",
            F.coalesce("source", F.lit("")).alias("_source"),
            F.col("source").isNull().alias("_none"),
            F.size(words(text)).cast("long").alias("size"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "mix-rows",
    )
    sources = rows.groupBy("_none", "_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = stored(numbered(sources, [F.col("_none"), F.col("_source")], "_index"), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = sources.withColumn("weight", cycled_weights(F.col("_index"), weights)).withColumn(
        "cap", F.col("source_size") * max_epochs
    )
    quota = F.least(F.round("target").cast("long"), F.col("cap"))
    sources = (
        water_filled(sources, share * total)
        .withColumn("_quota", quota)
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_quota div source_size")).otherwise(F.lit(0)))
        .withColumn("_rest", F.col("_quota") - F.col("_whole") * F.col("source_size"))
        .withColumn("_blocks", F.ceil(F.col("_rows") / F.lit(block_rows)))
        .drop("weight", "cap", "_rows")
    )
    placed = (
        attach(rows, stored(sources, "mix-targets"), ["_none", "_source"], "inner")
        .withColumn("_hash", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(1 << HASH_BITS)))
        .withColumn("_block", F.shiftright(F.col("_hash") * F.col("_blocks"), HASH_BITS))
    )
    ordered = running_total(placed, ["_index"], "_block", ["_hash", "doc_id", "text_hash"], "size", "_before")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    return ordered.select(
        "doc_id",
        "text_hash",
        "size",
        "source_size",
        "target",
        (F.col("_whole") * F.col("size") + extra).alias("taken"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: whole copies, then one cut to its first words if needed.

    A text cut short is its first words joined by single spaces; documents of which no word is taken go.  Copies
    keep the id.  ``n_chars``, if there, is counted anew.  Rows that repeat a row share its words evenly.
    """
    taken = stored(
        mix(docs, **options)
        .groupBy("doc_id", "text_hash", "size")
        .agg(F.sum("taken").alias("taken"), F.count("*").alias("n")),
        "mix-taken",
    )
    left = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(whole_text()).alias("hash"))
    same = F.col("row.doc_id").eqNullSafe(taken["doc_id"]) & (F.col("hash") == taken["text_hash"])
    both = left.join(taken.where(F.col("taken") > 0), same).select(
        "row", "size", F.ceil(F.col("taken") / F.col("n")).alias("share")
    )
    part = F.col("share") % F.col("size")
    lengths = F.concat(
        F.array_repeat(F.col("size"), F.expr("cast(share div size as int)")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    copies = both.select("row", "size", F.explode(lengths).alias("length"))
    head = F.array_join(F.slice(words(F.col("row.text")), 1, F.col("length").cast("int")), " ")
    text = F.when(F.col("length") == F.col("size"), F.col("row.text")).otherwise(head)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    return copies.select(*(new.get(n, F.col("row").getField(n)).alias(n) for n in docs.columns))
