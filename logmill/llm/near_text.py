"""Near duplicates by exact shingle similarity, on top of the SimHash components.

Differing bits of fingerprints say little at a similarity of 0.8 (about 10 bits of 64), and tries cannot be walked so
wide.  So texts are also linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more.  Pairs meet
in bands: 32 keys of 4 minima each, of which a pair at 0.8 shares none in 5 of 100 million cases.  Bands whose members
are all in one component are left out.

Pairs are looked at in three rounds, and texts linked in one are one for the next.  First each member of a band meets the
band's smallest one only, which connects large groups by one pair a member.  Then members meet in blocks of fixed size,
and of all likely pairs there a spanning forest is looked at, most alike first.  Last, all members of different
components meet that are in several blocks or where pairs were left out, and all likely pairs are looked at.

A pair is likely if its sets can be similar enough by the parities of their shingles in few places (sets that
differ in d shingles differ in at most d of them, so nothing is lost) and, in the last round, if 0.55 of its 128 minima are equal,
which a pair at 0.8 misses in fewer than 1 of a billion cases.  Either way pairs of ids are made distinct before their
texts are fetched, and whole texts decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import attach, discard, stored, whole_text

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: Bands looked at first, to connect large groups before all pairs that are left meet.
FIRST_BANDS = 4
#: A task compares the sketches of a band in two blocks of about so many.
BLOCK = 1_000
#: Least share of equal minima of a pair whose texts are fetched.
ESTIMATE = 0.55
#: A text's parities are a power of two, at least four for each shingle; the logarithms of the fewest and the most.
FEWEST, MOST = 9, 13
#: Pairs whose minima are compared at once.
TOGETHER = 10_000
SEED = 42

_rng = np.random.default_rng(SEED)
_ODD = _rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_FLIP = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``size`` lower-cased words; a shorter text is one run."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(word, SEED) for word in words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed += hashes[k : k + n] * _ODD[k]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * _ODD[-1] ^ np.uint64(size))


def minima(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 4096):
        part = (found[start : start + 4096, None] ^ _FLIP) * _TIMES
        np.minimum(least, part.min(axis=0), out=least)
    return least


def parities(found: np.ndarray) -> bytes:
    """A bit for each place, the lowest bits of a hash: whether an odd number of shingles have it."""
    bits = 1 << min(max((4 * len(found) - 1).bit_length(), FEWEST), MOST)
    places = (found & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def band_keys(least: np.ndarray) -> list[int]:
    """One signed key per band."""
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A text without words has no band."""
    for batch in batches:
        names, sizes, signs, odd, bands = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, size)
            least = minima(found)
            names.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63))
            sizes.append(len(found))
            signs.append((least >> np.uint64(32)).astype(np.uint32).tobytes())
            odd.append(parities(found))
            bands.append(band_keys(least) if len(found) else [])
        columns = {"text_hash": batch.column("text_hash"), "node": pa.array(names, pa.int64()), "size": pa.array(sizes, pa.int64())}
        columns |= {"minima": pa.array(signs, pa.binary()), "parities": pa.array(odd, pa.binary())}
        columns |= {"bands": pa.array(bands, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_pydict(columns)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 1000 >= round(similarity * 1000) * (len(a) + len(b) - both)


def likely_pairs(
    odd: list[bytes],
    signs: np.ndarray | None,
    sizes: np.ndarray,
    labels: np.ndarray,
    similarity: float,
    apart: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, differing): places of pairs with different labels whose sizes, parities and minima allow the similarity.

    ``differing`` is the number of parities that differ.  With ``apart``, only members whose values there differ meet.
    """
    found, limit = [(np.zeros(0, np.int64),) * 3], round(similarity * 1000)
    lengths = np.array([len(o) for o in odd])
    bits, members = np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
    # those with most parities first; members so far are folded to the fewer ones of the next
    for length in np.unique(lengths)[::-1].tolist():
        rows = np.flatnonzero(lengths == length)
        own = np.frombuffer(b"".join([odd[k] for k in rows]), np.uint64).reshape(len(rows), -1)
        while len(members) and bits.shape[1] > own.shape[1]:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        bits, members = np.concatenate([own, bits]) if len(members) else own, np.concatenate([rows, members])
        for k, row in enumerate(rows[: len(members) - 1].tolist()):
            near = members[k + 1 :]
            low, high = np.minimum(sizes[row], sizes[near]), np.maximum(sizes[row], sizes[near])
            others = (labels[near] != labels[row]) & (low * 1000 >= high * limit)
            if apart is not None:
                others &= apart[near] != apart[row]
            others = np.flatnonzero(others)
            if len(others):
                differ = np.bitwise_count(bits[others + k + 1] ^ bits[k]).sum(axis=1, dtype=np.int64)
                # S members of both sets, D of them in one only: a similarity of (S - D) / (S + D)
                some = differ * (1000 + limit) <= (low + high)[others] * (1000 - limit)
                found.append((np.full(int(some.sum()), row), near[others[some]], differ[some]))
    x, y, differ = (np.concatenate(c) for c in zip(*found))
    if signs is None:
        return x, y, differ
    least = ESTIMATE / SIMILARITY * similarity * signs.shape[1]
    parts = [slice(k, k + TOGETHER) for k in range(0, len(x), TOGETHER)]
    some = np.concatenate([np.zeros(0, bool), *((signs[x[p]] == signs[y[p]]).sum(axis=1) >= least for p in parts)])
    return x[some], y[some], differ[some]


def forest(x: np.ndarray, y: np.ndarray, differ: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which of the pairs span all that they connect, members of one label being connected before; least differing first."""
    above: dict[int, int] = {}

    def top(label: int) -> int:
        while (up := above.get(label, label)) != label:
            above[label] = label = above.get(up, up)
        return label

    order = np.argsort(differ, kind="stable")
    kept = []
    for k, one, two in zip(order.tolist(), labels[x[order]].tolist(), labels[y[order]].tolist()):
        one, two = top(one), top(two)
        if one != two:
            above[one] = two
            kept.append(k)
    return np.array(kept, np.int64)


def _first_pairs(nodes: DataFrame, bands: int) -> DataFrame:
    """(a, b): each member of a band with the band's smallest one, where their labels differ."""
    members = nodes.select("node", "label", F.explode(F.slice("bands", 1, bands)).alias("band"))
    least = members.groupBy("band").agg(
        F.min(F.struct("node", "label")).alias("s"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    least = stored(least.where("lo <> hi").select("band", F.col("s.node").alias("a"), F.col("s.label").alias("first")), "near-bands")
    met = attach(members, least, ["band"], "inner").where("label <> first")
    return met.select("a", F.col("node").alias("b")).distinct()


def _contested(nodes: DataFrame) -> DataFrame:
    """(band, n): bands whose members have different labels, and their members."""
    members = nodes.select("node", "label", F.explode("bands").alias("band"))
    several = members.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return several.where("lo <> hi").select("band", "n")


def _ends(names: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, pa.Array]:
    return {"a": pa.array(np.minimum(names[x], names[y]), pa.int64()), "b": pa.array(np.maximum(names[x], names[y]), pa.int64())}


def _forests(nodes: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b, band): a spanning forest of the likely pairs of different labels in each block of a band.

    ``band`` is null where the forest has all likely pairs of the block.
    """
    met = nodes.select("node", "label", "size", "parities", F.explode("bands").alias("band"))
    met = attach(met, stored(_contested(nodes), "near-bands"), ["band"], "inner")
    met = met.withColumn("i", F.expr(f"cast(pmod(xxhash64(band, node), ceil(n / {block})) as int)"))

    def spanning(group: pa.Table) -> pa.Table:
        names, sizes, labels = (group.column(c).to_numpy() for c in ("node", "size", "label"))
        x, y, differ = likely_pairs(group.column("parities").to_pylist(), None, sizes, labels, similarity)
        kept = forest(x, y, differ, labels)
        band = group.column("band")[0].as_py() if len(kept) < len(x) else None
        return pa.table(_ends(names, x[kept], y[kept]) | {"band": pa.array([band] * len(kept), pa.int64())})

    met = met.select("band", "i", "node", "label", "size", "parities")
    return met.groupBy("band", "i").applyInArrow(spanning, "a long, b long, band long")


def _all_pairs(nodes: DataFrame, similarity: float, block: int, among: DataFrame | None = None) -> DataFrame:
    """(a, b): likely pairs of different labels in all bands.  A large band is dealt into blocks, and all of them meet.

    With a stored table ``among`` of bands, those of one block that are not in it are left out.  Nodes have minima; if they
    have parities, these tell as well.
    """
    several = _contested(nodes)
    if among is not None:
        listed = attach(several, among.withColumn("listed", F.lit(True)), ["band"])
        several = listed.where(F.col("listed") | (F.col("n") > block)).select("band", "n")
    sketches = [c for c in ("minima", "parities") if c in nodes.columns]
    met = nodes.select("node", "label", "size", *sketches, F.explode("bands").alias("band"))
    met = attach(met, stored(several, "near-bands"), ["band"], "inner")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("band", "node"), F.col("blocks")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.where((F.col("blocks") == 1) | (F.col("i") != F.col("j")))
    own = [F.least("i", "j").alias("one"), F.greatest("i", "j").alias("two")]

    def pairs(group: pa.Table) -> pa.Table:
        signs = np.frombuffer(b"".join(group.column("minima").to_pylist()), np.uint32).reshape(group.num_rows, -1)
        odd = group.column("parities").to_pylist() if "parities" in sketches else [bytes(8)] * group.num_rows
        names, sizes, labels, dealt = (group.column(c).to_numpy() for c in ("node", "size", "label", "i"))
        one, two, blocks = (group.column(c)[0].as_py() for c in ("one", "two", "blocks"))
        found = [likely_pairs(odd, signs, sizes, labels, similarity, dealt)[:2]] if blocks > 1 else []
        # members of a block meet each other where it meets the next one, those of the last where it meets the one before
        for k in [one] * (two == one + 1 or blocks == 1) + [two] * (one + 2 == two + 1 == blocks):
            rows = np.flatnonzero(dealt == k)
            x, y, _ = likely_pairs([odd[r] for r in rows], signs[rows], sizes[rows], labels[rows], similarity)
            found.append((rows[x], rows[y]))
        return pa.table(_ends(names, *(np.concatenate(c) for c in zip(*found))))

    met = met.select("band", *own, "i", "blocks", "node", "label", "size", *sketches)
    return met.groupBy("band", "one", "two").applyInArrow(pairs, "a long, b long").distinct()


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b), stored: the labels of the pairs whose whole texts are similar."""
    listed = pairs = stored(pairs, "near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(nodes.join(wanted, "node", "left_semi").select("node", "text_hash", "label"), "near-wanted")
    text = docs.select(F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    text = attach(text, wanted.select("text_hash"), ["text_hash"], "left_semi").dropDuplicates(["text_hash"])
    text = stored(attach(text, wanted, ["text_hash"], "inner").select("node", "label", "text"), "near-texts")
    for end in ("a", "b"):
        known = text.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"), F.col("text").alias(f"{end}_text"))
        pairs = attach(pairs, known, [end], "inner")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, np.zeros(0, np.uint64)
        for batch in batches:
            kept = []
            for one, two in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()):
                if one != last:
                    last, found = one, shingles(one, size)
                kept.append(similar(found, shingles(two, size), similarity))
            chosen = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_pydict({"a": chosen.column("a_label"), "b": chosen.column("b_label")})

    alike = pairs.select("a_label", "b_label", "a_text", "b_text").mapInArrow(decide, "a long, b long")
    alike = stored(alike, "near-alike")
    for done in (listed, wanted, text):
        discard(done)
    return alike


def _relabelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = stored(simhash.components(edges).withColumnRenamed("root", "joined"), "near-labels")
    nodes = attach(nodes, found.withColumnRenamed("node", "root"), ["root"])
    return nodes.withColumn("label", F.coalesce("joined", "root")).drop("joined")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, **options
) -> DataFrame:
    """(doc_id, text_hash, root, component_id) as of ``simhash.near_duplicates``, whose links (``options``) all count.

    Texts are linked as well if their sets of ``shingle`` words are equal or similar enough; a text of fewer words is one
    shingle, and texts without words, null and empty ones, are linked with each other only.  Equal texts and repeated
    rows share a component, null ids count only where there is no other, ties go to the smallest id.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    base = stored(simhash.near_duplicates(docs, **options).select("doc_id", "text_hash", "root"), "near-base")
    rows = docs.select(F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    schema = "text_hash long, node long, size long, minima binary, parities binary, bands array<long>"
    sketched = rows.mapInArrow(lambda batches: _sketch(batches, shingle), schema).dropDuplicates(["text_hash"])
    roots = stored(base.groupBy("text_hash").agg(F.min("root").alias("root")), "near-roots")
    sketched = stored(attach(sketched, roots, ["text_hash"], "inner"), "near-sketches")
    # a set that several texts share has one node
    least = sketched.groupBy("node").agg(F.min("root").alias("b"), F.max("root").alias("hi"), F.min("text_hash").alias("text_hash"))
    least = stored(least, "near-equal")
    sets = stored(sketched.join(least.select("node", "text_hash"), ["node", "text_hash"], "left_semi"), "near-nodes")
    differ = least.where("b <> hi").select("node", "b")
    edges = attach(sketched.select("node", F.col("root").alias("a")), stored(differ, "near-differ"), ["node"], "inner").select("a", "b")
    edges = stored(edges, "near-links")
    discard(sketched)
    among = None
    for look in ("first", "forests", "all"):
        nodes = stored(_relabelled(sets, edges), "near-nodes")
        if look == "first":
            pairs = _first_pairs(nodes, FIRST_BANDS)
        elif look == "forests":
            found = stored(_forests(nodes, similarity, block), "near-forests")
            among = stored(found.where("band is not null").select("band").distinct(), "near-among")
            pairs = found.select("a", "b").distinct()
        else:
            pairs = _all_pairs(nodes, similarity, block, among)
        edges = edges.union(nodes.where("label <> root").select(F.col("root").alias("a"), F.col("label").alias("b")))
        edges = stored(edges.union(_linked(pairs, nodes, docs, shingle, similarity)), "near-links")
        discard(nodes)
    discard(sets)
    base = stored(_relabelled(base, edges), "near-components").select("doc_id", "text_hash", F.col("label").alias("root"))
    least = stored(base.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-first")
    return attach(base, least, ["root"]).select("doc_id", "text_hash", "root", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id; of repeated rows any one.

    All columns are kept as they are.  Of null ids, the row goes or stays like any other; one of all texts without words
    stays.  An empty table gives an empty one.
    """
    return simhash.first_of_each(docs, near_duplicates(docs, **options))
