"""Ranked lexical search by walking two trees at once, one over the items and one over the documents.

A document's coordinate is, for each term, an integer impact; an item's is the term's weight times its count.  A
node holds the maximum of each coordinate below it, so the product of an item node and a document node bounds the
score of every pair below.  A pair of nodes whose bound is under the weakest kth score of the node's items is pruned
whole; what is left is scored.  All numbers are integers below 2**53, so products in doubles are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import numbered, stored, whole_text

TOP = 20
#: Items of one walk, and the bytes of their texts; more items are walked block by block.
ITEMS, ITEM_BYTES = 2_000, 1 << 20
#: Documents that a task holds as one tree, and places in the leaves of either tree.
TREE_DOCS, LEAF_DOCS, LEAF_ITEMS = 2_048, 32, 8
#: Terms of one matrix product at most.
WIDTH = 4_096

_FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
TERMS = "doc_id long, n long, terms binary, tf binary"
FOUND = "number int, doc_id long, score long"


def split_terms(text: bytes) -> list[bytes]:
    """Letters and digits of ASCII, lower-cased, and everything beyond ASCII; all else parts the terms."""
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    place = shared.value.get
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            found = split_terms(text)
            if found:
                known = np.array([p for p in map(place, found) if p is not None], np.int32)
                terms, tf = np.unique(known, return_counts=True)
                rows.append((doc_id, len(found), terms.tobytes(), tf.astype(np.int32).tobytes()))
        columns = zip(*rows) if rows else ([], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n", "terms", "tf"])


def _holders(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(term, df) over the rows of a partition."""
    df = np.zeros(width, np.int64)
    for batch in batches:
        for terms in batch.column("terms").to_pylist():
            df[np.frombuffer(terms, np.int32)] += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "df": pa.array(df[some], pa.int64())})


def impacts(n: np.ndarray, tf: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
    m = 75 + 25 * n.astype(np.int64) * all_docs // all_terms
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


@dataclass
class Tree:
    """Rows in an order in which like ones are near, and the maxima of ever larger runs: ``levels[0]`` has the leaves'."""

    order: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def over(cls, rows: np.ndarray, leaf: int) -> Tree:
        """Rows are near that share their largest coordinate, then the next."""
        count = len(rows)
        if rows.shape[1] > 1:
            two = np.argpartition(rows, rows.shape[1] - 2, axis=1)[:, -2:]
            swap = rows[np.arange(count), two[:, 0]] > rows[np.arange(count), two[:, 1]]
            first, second = np.where(swap, two[:, 0], two[:, 1]), np.where(swap, two[:, 1], two[:, 0])
            order = np.lexsort((second, first))
        else:
            order = np.arange(count)
        levels = [np.maximum.reduceat(rows[order], np.arange(0, count, leaf), axis=0)]
        while len(levels[-1]) > 1:
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), 2), axis=0))
        return cls(order, levels)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T over the columns that b has anything in."""
    some = np.flatnonzero(b.any(axis=0))
    total = np.zeros((len(a), len(b)), a.dtype)
    for start in range(0, len(some), WIDTH):
        part = some[start : start + WIDTH]
        total += a[:, part] @ b[:, part].T
    return total


class Best:
    """The ``top`` best documents of each item: higher scores first, then smaller ids (null before all)."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.found: list[list[tuple[int, int, int, int | None]]] = [[] for _ in range(items)]
        self.weakest = np.zeros(items)

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        rows = self.found[item] + [(-int(s), i is not None, i or 0, i) for s, i in zip(scores.tolist(), ids)]
        rows.sort(key=lambda r: r[:3])
        self.found[item] = rows[: self.top]
        if len(rows) >= self.top:
            self.weakest[item] = -rows[self.top - 1][0]


def search(items: np.ndarray, item_tree: Tree, docs: np.ndarray, ids: list, best: Best) -> list[int]:
    """Walk both trees, adding to ``best``; returns how many pairs were scored, and how many there are."""
    doc_tree = Tree.over(docs, LEAF_DOCS)
    depth = max(len(item_tree.levels), len(doc_tree.levels))
    alive, scored = None, 0
    for level in range(depth - 1, -1, -1):
        i_level, d_level = min(level, len(item_tree.levels) - 1), min(level, len(doc_tree.levels) - 1)
        i_nodes, d_nodes = item_tree.levels[i_level], doc_tree.levels[d_level]
        if alive is None:
            alive = np.ones((len(d_nodes), len(i_nodes)), bool)
        else:  # children of the pairs that are left
            if d_level < len(doc_tree.levels) - 1:
                alive = alive[np.arange(len(d_nodes)) // 2]
            if i_level < len(item_tree.levels) - 1:
                alive = alive[:, np.arange(len(i_nodes)) // 2]
        leaf = LEAF_ITEMS << i_level
        weakest = np.minimum.reduceat(best.weakest[item_tree.order], np.arange(0, len(items), leaf))
        d_some, i_some = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(d_some):
            return [0, len(items) * len(docs)]
        bounds = np.zeros(alive.shape)
        bounds[np.ix_(d_some, i_some)] = product(d_nodes[d_some], i_nodes[i_some])
        alive = alive & (bounds > 0) & (bounds >= weakest)
    # leaves with the highest bounds first: they lift the weakest scores
    for place in np.argsort(-np.where(alive, bounds, -1).max(axis=1), kind="stable"):
        rows = doc_tree.order[place * LEAF_DOCS : (place + 1) * LEAF_DOCS]
        weakest = np.minimum.reduceat(best.weakest[item_tree.order], np.arange(0, len(items), LEAF_ITEMS))
        leaves = np.flatnonzero(alive[place] & (bounds[place] >= weakest))
        if not len(leaves):
            continue
        places = np.concatenate([np.arange(k * LEAF_ITEMS, min(len(items), (k + 1) * LEAF_ITEMS)) for k in leaves])
        places = item_tree.order[places]
        scores = product(items[places], docs[rows])
        scored += scores.size
        keep = (scores > 0) & (scores >= best.weakest[places][:, None])
        for k in np.flatnonzero(keep.any(axis=1)):
            some = np.flatnonzero(keep[k])
            best.add(int(places[k]), scores[k, some], [ids[r] for r in rows[some]])
    return [scored, len(items) * len(docs)]


@dataclass
class Queries:
    """A block of items: ``rows`` holds weight times count by item and term."""

    rows: np.ndarray
    all_docs: int
    all_terms: int

    def tree(self) -> Tree:
        return Tree.over(self.rows, LEAF_ITEMS)


def _walk(batches: Iterator[pa.RecordBatch], shared, top: int) -> Iterator[pa.RecordBatch]:
    queries: Queries = shared.value
    kind, width = queries.rows.dtype, queries.rows.shape[1]
    item_tree, best = queries.tree(), Best(len(queries.rows), top)
    for batch in batches:
        for start in range(0, batch.num_rows, TREE_DOCS):
            part = batch.slice(start, TREE_DOCS)
            docs = np.zeros((part.num_rows, width), kind)
            for row, n, terms, tf in zip(docs, *(part.column(c).to_pylist() for c in ("n", "terms", "tf"))):
                row[np.frombuffer(terms, np.int32)] = impacts(np.int64(n), np.frombuffer(tf, np.int32), queries.all_docs, queries.all_terms)
            search(queries.rows, item_tree, docs, part.column("doc_id").to_pylist(), best)
    rows = [(item, doc_id, -score) for item, found in enumerate(best.found) for score, _, _, doc_id in found]
    columns = list(zip(*rows)) if rows else ([], [], [])
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["number", "doc_id", "score"]
    )


def item_blocks(items: DataFrame, limit: int = ITEMS, limit_bytes: int = ITEM_BYTES) -> Iterator[list[Row]]:
    """Blocks of (_nr, item_id, text) in order of their number, each bounded by rows and bytes."""
    order = [F.col("item_id"), F.xxhash64("text")]
    known = stored(numbered(items.select("item_id", whole_text().alias("text")), order, "_nr"), "search-items")
    sizes, start = known.select("_nr", F.octet_length("text").alias("size")), 0
    while True:
        # at most ``limit`` rows of two numbers
        ahead = sizes.where((F.col("_nr") >= start) & (F.col("_nr") < start + limit)).orderBy("_nr").collect()
        if not ahead:
            return
        total, end = 0, start
        for row in ahead:
            if end > start and total + row["size"] > limit_bytes:
                break
            total, end = total + row["size"], row["_nr"] + 1
        yield known.where((F.col("_nr") >= start) & (F.col("_nr") < end)).orderBy("_nr").collect()
        start = end


def _search_block(rows: DataFrame, block: list[Row], top: int) -> DataFrame:
    """(_nr, doc_id, score) of the best documents of a block of items, up to ``top`` for each task."""
    context = rows.sparkSession.sparkContext
    terms = [split_terms(row["text"].encode()) for row in block]
    place = {term: k for k, term in enumerate(sorted(set().union(*terms)))}
    width = len(place)
    shared = context.broadcast(place)  # bounded by ITEM_BYTES
    counted = stored(rows.mapInArrow(lambda batches: _count(batches, shared), TERMS), "search-terms")
    sums = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(width, np.int64)
    held = counted.select("terms").mapInArrow(lambda batches: _holders(batches, width), "term long, df long")
    for row in held.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most one row per term of the block
        df[row["term"]] = row["df"]
    shared.destroy()
    weights = [math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * int(n) + 1))) for n in df]
    matrix = np.zeros((len(block), width), np.int64)
    for k, found in enumerate(terms):
        for term in found:
            matrix[k, place[term]] += weights[place[term]]
    # an impact is below 1,000,000
    exact = float(matrix.sum(axis=1).max(initial=0)) * 1e6 < 2**53
    queries = Queries(matrix.astype(np.float64) if exact else matrix, sums["docs"], sums["terms"] or 1)
    numbers = rows.sparkSession.createDataFrame([(k, row["_nr"]) for k, row in enumerate(block)], "number int, _nr long")
    shared_queries = context.broadcast(queries)
    found = stored(counted.mapInArrow(lambda batches: _walk(batches, shared_queries, top), FOUND), "search-found")
    shared_queries.destroy()
    return found.join(F.broadcast(numbers), "number").select("_nr", "doc_id", "score")  # one row per item of the block


def search_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, limit: int = ITEMS, limit_bytes: int = ITEM_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents, ranked from 1.

    ``docs`` has doc_id and text, ``items`` item_id and text.  Only scores above 0 count; equal ones go by doc_id, null
    before all.  A null or empty text has no term: it is no document, and an item without one finds nothing.  Repeated
    documents count and are listed each; each row of ``items`` is an item of its own, repeated or not.  Other columns
    are ignored; an empty table on either side gives an empty result.

    Blocks of items (``limit`` rows, ``limit_bytes`` of text) pass the driver; every document meets every block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    names = items.select("item_id").schema
    result, keys = None, None
    for block in item_blocks(items, limit, limit_bytes):
        if any(split_terms(row["text"].encode()) for row in block):
            found = _search_block(rows, block, top)
            ids = docs.sparkSession.createDataFrame([(row["item_id"], row["_nr"]) for row in block], names.add("_nr", "long"))
            names = items.select("item_id").schema
            result = found if result is None else result.unionByName(found)
            keys = ids if keys is None else keys.unionByName(ids)
    if result is None:
        empty = docs.sparkSession.createDataFrame([], names)
        return empty.select("item_id", *(F.lit(0).cast(t).alias(n) for n, t in (("rank", "int"), ("doc_id", "long"), ("score", "long"))))
    rank = F.row_number().over(Window.partitionBy("_nr").orderBy(F.desc("score"), F.asc("doc_id")))
    ranked = result.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(keys, "_nr").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
sums AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), sums),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))) AS part
  FROM counts JOIN lengths USING (doc_id) JOIN weights USING (term), sums),
scores AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
