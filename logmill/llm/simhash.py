"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints link at few differing bits.  Two of them that differ in at most 3 of 64 bits share one of four blocks
of 16 bits (with another budget, one of budget + 1 blocks), so each block value roots a trie of its own, and Spark
deals these tries to the tasks.  A root that holds very
many fingerprints (a large group of near copies) is split further: of the 6 bytes outside the block at least 3 are equal,
so it is rooted anew at each choice of 3 more bytes; such a trie has 24 free bits, which bounds its size.

A task walks pairs of trie nodes together.  It starts with a root paired with itself, goes down both sides bit by bit,
adds up the differing bits and prunes a pair above the budget.  A pair whose leaves are known to be connected already is
pruned as well: only components are asked for, so a dense group gives one link per fingerprint and not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, stored, whole_text

BUDGET = 3
SHINGLE = 3
SEED = 42
#: Roots with more fingerprints are rooted anew with three more bytes fixed.
SPLIT_ABOVE = 20_000
#: Rows that a task gathers, in whole tries, before it walks them.
BUFFER = 200_000
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 64
CHUNK = 50_000


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint: bit i is 1 if it is set in over half of the shingles' hashes; 0 if no word."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    parts = zip(*(words[k:] for k in range(shingle))) if len(words) > shingle else iter([words])
    n, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        size = min(1 << 16, n - start)
        hashes = np.fromiter((digest(join(next(parts)), seed) for _ in range(size)), "<u8", size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprint(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [simhash(text, shingle) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(found, pa.int64())}
        )


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp), one row for each row of ``docs``; a null text counts as empty."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(lambda batches: _fingerprint(batches, shingle), "doc_id long, text_hash long, fp long")


class Forest:
    """Union-find over the rows of a buffer, in whole arrays; the root of a set is its smallest row."""

    def __init__(self, size: int):
        self.parent = np.arange(size)
        self.merged = 0

    def find(self, rows: np.ndarray) -> np.ndarray:
        roots = self.parent[rows]
        while True:
            above = self.parent[roots]
            if np.array_equal(above, roots):
                return roots
            roots = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self.merged += len(a)

    def labels(self) -> np.ndarray:
        self.parent = self.find(np.arange(len(self.parent)))
        return self.parent


def walk_tries(key: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """The row, of the smallest fingerprint, that each row is connected with inside its trie.

    ``fp`` (unsigned) is sorted within the runs of equal ``key``; a run is one trie.
    """
    forest = Forest(len(fp))
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(key)]
    several = ends - starts > 1
    lo, hi = starts[several], ends[several]
    label, changes, known = None, None, 0
    todo = [(63, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while todo:
        bit, pairs = todo.pop()
        if pairs.shape[1] > CHUNK:
            todo.append((bit, pairs[:, CHUNK:]))
            pairs = pairs[:, :CHUNK]
        if forest.merged - known > len(fp) >> 4:
            label, known = forest.labels(), forest.merged
            changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        if label is not None:  # both nodes lie in one component
            a, a_end, b, b_end, _ = pairs
            one = (changes[a] == changes[a_end - 1]) & (changes[b] == changes[b_end - 1]) & (label[a] == label[b])
            pairs = pairs[:, ~one]
        small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= LEAF_PAIRS
        if bit < 0:
            small[:] = True
        _compare_leaves(fp, pairs[:, small], budget, forest)
        pairs = pairs[:, ~small]
        if pairs.shape[1]:
            todo.append((bit - 1, _children(fp, pairs, bit, budget)))
    return forest.labels()


def _compare_leaves(fp: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest) -> None:
    a, a_end, b, b_end, _ = pairs
    sizes = (a_end - a) * (b_end - b)
    if not len(sizes):
        return
    which = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = (b_end - b)[which]
    left, right = a[which] + place // width, b[which] + place % width
    near = (left != right) & (np.bitwise_count(fp[left] ^ fp[right]) <= budget)
    forest.link(left[near], right[near])


def _children(fp: np.ndarray, pairs: np.ndarray, bit: int, budget: int) -> np.ndarray:
    """Pairs of child nodes within the budget.  A node is a range of rows that share all bits above ``bit``."""
    a, a_end, b, b_end, differing = pairs
    a_mid, b_mid = _first_one(fp, a, a_end, bit), _first_one(fp, b, b_end, bit)
    same = a == b
    found = np.concatenate(
        [
            np.stack([a, a_mid, b, b_mid, differing]),
            np.stack([a_mid, a_end, b_mid, b_end, differing]),
            np.stack([a, a_mid, b_mid, b_end, differing + 1]),
            np.stack([a_mid, a_end, b, b_mid, differing + 1])[:, ~same],  # else the mirror image of the one before
        ],
        axis=1,
    )
    return found[:, (found[0] < found[1]) & (found[2] < found[3]) & (found[4] <= budget)]


def _first_one(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First row of each sorted range in which ``bit`` is set, by binary search in all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        middle = (lo + hi) >> 1
        one = (fp[np.minimum(middle, len(fp) - 1)] >> np.uint64(bit)) & np.uint64(1) == 1
        hi = np.where(open_ & one, middle, hi)
        lo = np.where(open_ & ~one, middle + 1, lo)
    return lo


def _walk(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, fp) sorted by root to links (a, b): whole tries are gathered up to BUFFER rows and walked."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        label = walk_tries(key, fp, budget)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        ends = [pa.array(fp[rows].view(np.int64), pa.int64()) for rows in (linked, label[linked])]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    keys: list[np.ndarray] = []
    fps: list[np.ndarray] = []
    size = 0
    for batch in batches:
        key, fp = batch.column("root").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(key):
            continue
        if size >= BUFFER and key[0] != keys[-1][-1]:
            yield links(np.concatenate(keys), np.concatenate(fps))
            keys, fps, size = [], [], 0
        elif size >= BUFFER and key[-1] != key[0]:  # the open trie ends in this batch
            cut = int(np.flatnonzero(key != key[0])[0])
            yield links(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps, fp[:cut]]))
            keys, fps, size, key, fp = [], [], 0, key[cut:], fp[cut:]
        keys.append(key)
        fps.append(fp)
        size += len(key)
    if keys:
        yield links(np.concatenate(keys), np.concatenate(fps))


def _masked(fp: Column, mask: int) -> Column:
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` near equal runs of ``bits``."""
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << bit for bit in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def root_masks(budget: int = BUDGET) -> tuple[list[int], list[list[int]]]:
    """Blocks of which one is equal at ``budget`` differing bits, and for each the finer choices, one of which is equal.

    There are budget + 1 blocks.  The bits outside a block make budget + k parts, of which at least k are equal.
    """
    blocks = _parts(list(range(64)), budget + 1)
    equal = 3 if budget <= 3 else 2 if budget <= 8 else 1
    finer = []
    for block in blocks:
        outside = [bit for bit in range(64) if not block >> bit & 1]
        finer.append([block | sum(chosen) for chosen in combinations(_parts(outside, budget + equal), equal)])
    return blocks, finer


def roots(nodes: DataFrame, split_above: int = SPLIT_ABOVE, budget: int = BUDGET) -> DataFrame:
    """(root, fp): each fingerprint below every root, a choice of fixed bits and their values."""
    blocks, masks = root_masks(budget)
    tables = F.array(*(F.struct(F.lit(k).alias("block"), _masked(F.col("fp"), m).alias("bits")) for k, m in enumerate(blocks)))
    first = nodes.select("fp", F.inline(tables))
    hot = stored(first.groupBy("block", "bits").count().where(F.col("count") > split_above), "hot-roots")
    marked = attach(first, hot, ["block", "bits"])
    names = [F.array(*(F.xxhash64(F.lit(f"{b}.{k}"), _masked(F.col("fp"), m)) for k, m in enumerate(masks[b]))) for b in range(len(blocks))]
    finer = F.element_at(F.array(*names), F.col("block") + 1)
    plain = F.array(F.xxhash64(F.col("block"), F.col("bits")))
    # roots are named by a hash; a collision only puts two tries into one walk, which compares whole fingerprints
    return marked.select(F.explode(F.when(F.col("count").isNull(), plain).otherwise(finer)).alias("root"), "fp")


def links(nodes: DataFrame, budget: int = BUDGET, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(a, b): a spanning forest of the links inside each trie, b the smallest (unsigned) of its tree."""
    below = roots(nodes, split_above, budget).repartition("root").sortWithinPartitions("root")
    return below.mapInArrow(lambda batches: _walk(batches, budget), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with edges, root the smallest node reachable, by large and small stars in turn.

    Every round is stored; hubs are met by adaptive skew splitting, since a hub's minimum is one row.
    """

    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.where("a <> b").distinct(), "edges")
    seen = None
    while (now := signature(edges)) != seen:
        seen = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b"), F.col("b")).distinct()
    )


def near_duplicates(
    docs: DataFrame, budget: int = BUDGET, split_above: int = SPLIT_ABOVE, shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id), one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links; null ids count only where there is no other.
    ``root`` names the component by a fingerprint.  A null, empty or blank text has fingerprint zero and is linked
    like any other.  Equal texts and repeated rows share a fingerprint.  Other columns are ignored; an empty table gives an
    empty result.
    """
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    found = components(links(nodes.select("fp"), budget, split_above))
    placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stored(placed, "fingerprint-roots")
    first = stored(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    named = stored(attach(placed.select("fp", "root"), first, ["root"]), "fingerprint-components")
    return attach(marked, named, ["fp"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id; of repeated rows any one."""
    return first_of_each(docs, near_duplicates(docs, **options))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their component in ``found``, repeated ones once.

    What goes is looked up, since it is mostly less than what stays; only rows that repeat are shuffled.
    """
    key = ["_id", "_none", "text_hash"]
    keys = [F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.col("doc_id").isNull().alias("_none")]
    held = stored(found.select(*keys, "text_hash", "doc_id", "root", "component_id"), "group-rows")
    first = held.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct(*key)).alias("k"))
    kept = stored(first.select("k.*"), "group-first")
    gone = stored(held.join(kept, key, "left_anti").select(*key).distinct(), "group-gone")
    again = stored(held.join(gone, key, "left_anti").groupBy(*key).count().where("count > 1").select(*key), "group-again")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *keys, F.xxhash64(whole_text()).alias("text_hash"))
    rows = attach(rows, gone, key, "left_anti")
    once = attach(rows, again, key, "left_anti").select("row.*")
    return once.union(attach(rows, again, key, "left_semi").dropDuplicates(key).select("row.*"))
