"""Token counts of whole texts; huge ones are encoded in overlapping chunks that resynchronise.

A text is cut into chunks of ``chunk`` code points, each with ``overlap`` more on both sides.  Around a cut, the chunk
before reads the overlap behind its own text, the chunk after begins with it.  They are spliced at the first place
where both encodings have the same run of tokens at the same offsets, and which stands behind white space: the
vocabulary's pattern drops white space and joins nothing across it, so tokens behind such a place do not depend on
what stands before it.  Both neighbours compare the same two encodings and so find the same place.  Where a cut has
none, the document is encoded again with chunks and overlaps widened, up to all of it as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text
from .encoding import Encoder

CHUNK = 1 << 14
OVERLAP = 256
LIMIT = 2048
WIDEN = 4
#: Tokens in a row that both encodings must share.
AGREE = 3

_SPACE = frozenset(" \t\n\r\x0b\x0c")
_KEY = ("doc_id", "text_hash", "n_bytes")
COUNTED = "doc_id long, text_hash long, n_bytes long, chunk int, n_tokens long, aligned boolean"


def splice_point(encoder: Encoder, text: str, cut: int, overlap: int) -> int | None:
    """The stable common boundary near ``cut``: a position in ``text``, or None if the overlap holds none."""
    start, end = max(0, cut - overlap), min(len(text), cut + overlap)
    before = [(a + start, b + start, t) for a, b, t in encoder.offsets(text[start:end])]
    after = [(a + cut, b + cut, t) for a, b, t in encoder.offsets(text[cut:end])]
    place = {token[0]: k for k, token in enumerate(before)}
    # the last token may be cut off by the end of the overlap: it proves nothing
    for k in range(len(after) - AGREE):
        at = after[k][0]
        j = place.get(at)
        if j is not None and at > cut and text[at - 1] in _SPACE and before[j : j + AGREE] == after[k : k + AGREE]:
            return at
    return None


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str | None, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary)
    for batch in batches:
        texts, aligned = [], []
        for text, k, last in zip(*(batch.column(c).to_pylist() for c in ("text", "chunk", "last"))):
            own = overlap if k else 0
            first = splice_point(encoder, text, own, overlap) if k else 0
            end = len(text) if k == last else splice_point(encoder, text, own + chunk, overlap)
            aligned.append(first is not None and end is not None)
            texts.append(text[first:end] if aligned[-1] else "")
        columns = {c: batch.column(c) for c in (*_KEY, "chunk")}
        columns["n_tokens"] = pa.array([len(ids) >> 1 for ids in encoder(texts)], pa.int64())
        columns["aligned"] = pa.array(aligned, pa.bool_())
        yield pa.RecordBatch.from_pydict(columns)


def chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk.  The last chunk is one to two chunks long.  Only chunks of huge texts are dealt out anew."""
    last = F.greatest(F.lit(0), F.expr(f"cast(length(text) div {chunk} as int)") - 1)
    rows = rows.withColumn("last", last)
    start = F.greatest(F.lit(0), F.col("chunk") * chunk - overlap)
    end = F.when(F.col("chunk") == F.col("last"), F.length("text")).otherwise((F.col("chunk") + 1) * chunk + overlap)
    whole = rows.where("last = 0").withColumn("chunk", F.lit(0))
    pieces = (
        rows.where("last > 0")
        .select("*", F.explode(F.sequence(F.lit(0), "last")).alias("chunk"))
        .withColumn("text", F.substring("text", start + 1, end - start))
        .repartition("doc_id", "chunk")
    )
    return whole.unionByName(pieces)


def count_tokens(
    docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chunks), one row for each row of ``docs``.

    Texts of two chunks and more are cut and spliced; ``n_chunks`` tells into how many.  A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are returned as often; rows that share an id
    with different texts, and null ids, are counted apart.  Other columns are ignored; an empty table gives an
    empty result.
    """
    text = whole_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    done, pending = [], rows
    while True:
        counted = chunks(pending, chunk, overlap).select(*_KEY, "chunk", "last", "text").mapInArrow(
            lambda batches, c=chunk, o=overlap: _count(batches, vocabulary, c, o), COUNTED
        )
        # repeated rows have the same chunks
        per_chunk = counted.groupBy(*_KEY, "chunk").agg(
            F.max("n_tokens").alias("n_tokens"), F.bool_and("aligned").alias("aligned"), F.count("*").alias("copies")
        )
        per_text = stored(
            per_chunk.groupBy(*_KEY).agg(
                F.sum("n_tokens").alias("n_tokens"),
                F.bool_and("aligned").alias("aligned"),
                F.max("copies").cast("int").alias("copies"),
                F.count("*").alias("n_chunks"),
            ),
            "token-counts",
        )
        done.append(per_text.where("aligned"))
        failed = per_text.where("not aligned")
        if failed.isEmpty():
            break
        again = failed.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        pending = rows.join(again, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_hash == F.col("_hash")), "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("*", F.explode(F.sequence(F.lit(1), "copies"))).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks"
    )
