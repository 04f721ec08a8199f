"""Packing documents into token sequences along a space-filling curve.

A document's hashed token vector is projected to few dimensions; its Hilbert key puts like documents side by side.
The documents are range-sorted by that key, laid end to end, and cut every ``length`` tokens: neighbours on the curve
share a sequence, and only the very last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import running_offsets
from .common import in_order, stored, whole_text
from .encoding import Encoder

LENGTH = 4096
END_ID = 2
DIMENSIONS = 3
BITS = 16
SEED = 9
#: Bits of a coordinate in a sum over token ids.
FIELD = 21
#: Documents that a task encodes at once.
ENCODE_ROWS = 500

ENCODED = "uid long, doc_id long, curve long, n long, ids binary"
PLACED = "uid long, _part int, n long, inside long"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"
)


def projection(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """One random direction of signs per token id: the hashed vector and its projection in one table."""
    signs = np.random.default_rng(seed).integers(0, 2, (1 << 16, dimensions), dtype=np.int8)
    return (2 * signs - 1).astype(np.float32)


def projected(ids: np.ndarray, codes: np.ndarray, dimensions: int) -> np.ndarray:
    """Mean direction of token ids; ``codes`` has a field of ``FIELD`` bits for each coordinate, 1 where it is positive."""
    positive = np.zeros(dimensions, np.int64)
    for start in range(0, len(ids), 1 << FIELD - 1):
        total = int(codes[ids[start : start + (1 << FIELD - 1)]].sum())
        positive += [total >> FIELD * k & (1 << FIELD) - 1 for k in range(dimensions)]
    return (2 * positive - len(ids)) / len(ids)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (one per row, ``bits`` per coordinate)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    # undo the rotations and reflections of the cells, from the largest to the smallest
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
    # Gray code
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        t ^= np.where(x[n - 1] & q, q - 1, 0)
    x ^= t
    key = np.zeros_like(t)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = ENCODE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, since their texts, pieces and ids are all held at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    encoder, table = Encoder(vocabulary), projection()
    codes = ((table > 0).astype(np.int64) << np.arange(0, FIELD * table.shape[1], FIELD)).sum(axis=1)
    for batch in _sliced(batches):
        encoded = list(encoder(batch.column("text").to_pylist()))
        means = np.zeros((len(encoded), table.shape[1]))
        for k, ids in enumerate(encoded):
            if ids:
                means[k] = projected(np.frombuffer(ids, np.uint16), codes, table.shape[1])
        points = np.clip((means + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "uid": batch.column("uid"),
                "doc_id": batch.column("doc_id"),
                "curve": pa.array(hilbert_keys(points), pa.int64()),
                "n": pa.array([len(ids) // 2 + 1 for ids in encoded], pa.int64()),
                "ids": pa.array(encoded, pa.binary()),
            }
        )


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running totals of one sorted partition, carried from batch to batch."""
    total = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        inside = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_pydict(
            {c: batch.column(c) for c in ("uid", "_part", "n")} | {"inside": pa.array(inside, pa.int64())}
        )


def _cut(batches: Iterator[pa.RecordBatch], length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "curve", "n", "ids", "_at")
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for doc_id, curve, n, ids, at in zip(*(batch.column(c).to_pylist() for c in names)):
            whole = np.append(np.frombuffer(ids, np.uint16), end_id).astype("<u4")
            start = 0
            while start < n:
                place = (at + start) % length
                size = min(n - start, length - place)
                crc = zlib.crc32(whole[start : start + size].tobytes())
                for column, value in zip(out, (doc_id, start, size, crc, n, (at + start) // length, place, curve)):
                    column.append(value)
                start += size
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in out],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve"],
        )


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and place there.

    A null or empty text is its end id alone.  Order: curve key, then doc_id (nulls first); repeated rows are
    documents of their own.  ``sequence_id`` and, in it, ``offset`` have no gaps.  Other columns are ignored; an
    empty table gives an empty result.

    Texts are encoded once; the ids are stored in the shared folder, and only keys and lengths are sorted.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        whole_text().alias("text"),
    )
    encoded = stored(rows.mapInArrow(lambda batches: _encode(batches, vocabulary), ENCODED), "pack-ids")
    placed = in_order(encoded.select("uid", "doc_id", "curve", "n"), [F.col("curve"), F.col("doc_id"), F.col("uid")])
    inside = placed.select("uid", "_part", "n").mapInArrow(_sum_up, PLACED)
    sizes = placed.groupBy("_part").agg(F.sum("n").alias("n"))
    # one row per partition
    offsets = F.broadcast(running_offsets(sizes, ["_part"]).select("_part", "_offset"))
    at = inside.join(offsets, "_part").select("uid", (F.col("inside") + F.col("_offset")).alias("_at"))
    return (
        encoded.join(at.hint("shuffle_hash"), "uid")
        .select("doc_id", "curve", "n", "ids", "_at")
        .mapInArrow(lambda batches: _cut(batches, length, end_id), PIECES)
    )
