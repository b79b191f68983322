"""Near-duplicates by circulant MinHash, verified on whole sets of shingles.

Two fixed permutations of the 32-bit numbers serve for a whole signature. The first one scatters the shingles; the second,
shifted circularly by 0, 1, 2, ..., gives one coordinate per shift: the least of its values over the set. Six
coordinates make a band, 40 bands a signature. Two sets of similarity 0.8 miss each other in all bands with a
chance of 1 in 190,000, more similar ones less; sets of similarity 0.05 meet in one of 1.6 million pairs.

Documents of equal sets are one node. Nodes that share a band meet in a bucket, and no bucket gives out its pairs: its
members are compared with one of them, the least; then, in buckets still in several components, with the member that
has most links; what is left in several components after that is compared in blocks, inside tasks, by products of matrices,
and only links that connect are given out. So every bucket ends with all its similar members connected, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.common import batches_of, mixed, pack, rolled, unpack
from headroom.llm.components import components
from headroom.session import settle

SHINGLE = 2
PERCENT = 80
BANDS, ROWS = 40, 6
HUB_BUCKET = 32  # larger buckets get a second centre before the rest is compared in blocks
BLOCK, BLOCK_SHINGLES = 512, 1 << 18  # bounds of a block
PER_CENTRE = 256  # members that travel with one copy of their centre
_BASE = 0x9E3779B97F4A7C15
_TEXT_BYTES = 1 << 22
_AT_ONCE = 256  # shingles whose coordinates fit into a cache
_CELLS = 1 << 22  # of a table of sets and shingles


# sets and signatures -----------------------------------------------------------------------------------


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The set of word shingles, lower-cased (A-Z), as sorted 64-bit hashes; fewer words are one shingle."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(mixed(rolled(hashes, min(size, len(words)), _BASE) + np.uint64(min(size, len(words)))))


def _permuted(values: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place: every step can be undone."""
    values ^= values >> np.uint32(16)
    values *= np.uint32(0x7FEB352D)
    values ^= values >> np.uint32(15)
    values *= np.uint32(0x846CA68B)
    values ^= values >> np.uint32(16)
    return values


def signature(elements: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k: the least value of the second permutation, shifted by k, over the set scattered by the first."""
    scattered = _permuted((elements ^ (elements >> np.uint64(32))).astype(np.uint32))
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    for begin in range(0, len(scattered), _AT_ONCE):
        np.minimum(least, _permuted(scattered[begin : begin + _AT_ONCE] - shifts).min(axis=1), out=least)
    return least


def bands(elements: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band, told apart by the band's number."""
    parts = signature(elements, count * rows).reshape(count, rows).astype(np.uint64)
    keys = np.arange(1, count + 1, dtype=np.uint64)
    for column in parts.T:
        keys = mixed(keys * np.uint64(_BASE) + column)
    return keys


_PRINT = "doc_id bigint, n_shingles bigint, node decimal(38,0), bands array<bigint>, packed binary"


def _number(elements: np.ndarray) -> Decimal:
    """126 bits of hash of a set, as a number that fits a decimal."""
    return Decimal(int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=16).digest(), "big") >> 2)


def _prints(docs: DataFrame) -> DataFrame:
    """Per row its set's size, number and bands, and the packed text; sets without shingles have no bands."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", _TEXT_BYTES):
                known: dict[Decimal, list[int]] = {}  # copies near each other have one signature
                sizes, nodes, found, texts = [], [], [], []
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode()
                    elements = shingles(raw)
                    node = _number(elements)
                    if node not in known:
                        known[node] = bands(elements).view(np.int64).tolist() if len(elements) else []
                    sizes.append(len(elements))
                    nodes.append(node)
                    found.append(known[node])
                    texts.append(pack(raw))
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.decimal128(38, 0))]
                columns += [pa.array(found, pa.list_(pa.int64())), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "bands", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(convert, _PRINT).withColumn("row", F.monotonically_increasing_id())


_LINK = "a decimal(38,0), b decimal(38,0)"


# comparing ---------------------------------------------------------------------------------------------


def similar(common: np.ndarray | int, one: np.ndarray | int, other: np.ndarray | int):
    """Whether sets of these sizes with so many elements in common are linked."""
    return 100 * common >= PERCENT * (one + other - common)


def _may_be_similar(one: str, other: str) -> Column:
    """The smaller set inside the larger one would have to be similar enough."""
    return F.expr(f"100 * least({one}, {other}) >= {PERCENT} * greatest({one}, {other})")


def _compare_with_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by centre and chunk, the centre first; links of the members that are similar to it."""
    now, centre = None, None
    for batch in batches:
        links = []
        for a, chunk, node, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "node", "packed"))):
            elements = shingles(unpack(blob))
            if (a, chunk) != now:
                now, centre = (a, chunk), elements
            elif similar(len(np.intersect1d(centre, elements, assume_unique=True)), len(centre), len(elements)):
                links.append((a, node))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.decimal128(38, 0)) for c in zip(*links)], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among distinct pairs ``a, b``. A centre ``a`` travels once for some hundred members, not once for each."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("b"), F.expr(f"n div {PER_CENTRE} + 1")).alias("chunk")
    placed = settle(pairs.join(counts, "a").select("a", "b", chunk))
    own = texts.select("node", "packed")
    centres = placed.select("a", "chunk").distinct().join(own, F.col("a") == F.col("node")).withColumn("place", F.lit(0))
    members = placed.join(own, F.col("b") == F.col("node")).withColumn("place", F.lit(1))
    columns = ["a", "chunk", "place", "node", "packed"]
    met = centres.select(columns).unionByName(members.select(columns)).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "place")
    return met.mapInArrow(_compare_with_centre, _LINK)


def in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share, by products of tables of elements that several sets have."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    places = np.cumsum(counts > 1) - 1
    kept = counts[inverse] > 1
    rows, columns = owners[kept], places[inverse[kept]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, _CELLS // len(sets))
    for begin in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        low, high = np.searchsorted(columns, (begin, begin + width))
        table = np.zeros((len(sets), width), np.float32)
        table[rows[low:high], columns[low:high] - begin] = 1
        common += table @ table.T
    return common


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a symmetric table of neighbours connects, one less than members each."""
    left, links = np.arange(len(near)), []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            reached, grown = np.zeros(len(left), bool), []
            for one in frontier:
                at = np.flatnonzero(near[one][left] & ~reached)
                links += [(int(one), int(left[i])) for i in at]
                reached[at] = True
            grown, left = left[reached], left[~reached]
            frontier = grown
    return links


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and pair of blocks; a spanning forest of the links of each."""
    now, nodes, sets = None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            sizes = np.array([len(s) for s in sets])
            found = spanning(similar(in_common(sets), sizes[:, None], sizes[None, :]))
            if found:
                columns = [pa.array([nodes[pair[i]] for pair in found], pa.decimal128(38, 0)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    for batch in batches:
        for *key, node, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "packed"))):
            if key != now:
                yield from out()
                now, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(shingles(unpack(blob)))
    yield from out()


def _verified_in_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that connect the similar members of each ``bucket``; buckets are cut into blocks, all pairs of which meet."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.expr(f"1 + greatest(n div {BLOCK}, total div {BLOCK_SHINGLES})").alias("blocks")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).alias("own")
    dealt = members.select("bucket", "node").join(sizes.select("bucket", blocks), "bucket").select("bucket", "node", "blocks", own)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("bucket", "node", "own", other)
    dealt = dealt.select("bucket", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = dealt.join(texts.select("node", "packed"), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return met.select("bucket", "i", "j", "node", "packed").mapInArrow(_compare_blocks, _LINK)


# buckets -----------------------------------------------------------------------------------------------


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` of buckets in several components of ``links``, with their ``root``."""
    roots = components(links)
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return settle(rooted.join(apart.select("bucket"), "bucket"))


def _pairs_with(centres: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pairs of the centre of a bucket (``a, a_n, a_root``) and its members in other components."""
    met = members.join(centres, "bucket").where("root != a_root").where(_may_be_similar("n_shingles", "a_n"))
    return met.select("a", F.col("node").alias("b")).distinct()


def _centres(members: DataFrame, best: Column) -> DataFrame:
    """One member per bucket: the one that comes first by ``best``."""
    first = members.groupBy("bucket").agg(F.min(F.struct(best, "node", "n_shingles", "root")).alias("f"))
    return first.select("bucket", F.col("f.node").alias("a"), F.col("f.n_shingles").alias("a_n"), F.col("f.root").alias("a_root"))


def _distinct_buckets(members: DataFrame) -> DataFrame:
    """Buckets of the same members once: bands of one pair or group mostly agree."""
    hashes = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")
    )
    return members.join(hashes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def _candidates(sets: DataFrame) -> DataFrame:
    """``bucket, node, n_shingles`` of all buckets with several nodes, buckets of the same nodes once, written.

    Joins of what grows with the corpus name their kind, so that their plan is the same at every size.
    """
    spread = sets.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    own = F.xxhash64("node")
    shared = spread.groupBy("bucket").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low < high").select("bucket")
    met = spread.join(settle(shared).hint("merge"), "bucket")
    return settle(_distinct_buckets(settle(met.groupBy("bucket", "node").agg(F.min("n_shingles").alias("n_shingles")))))


def links(sets: DataFrame) -> DataFrame:
    """Verified links ``a, b`` that connect all similar nodes that share a band. ``sets``: ``node, n_shingles, bands, packed, row``.

    Rows of one node have the same set; the text of the first one stands for it.
    """
    members = _candidates(sets)
    firsts = sets.groupBy("node").agg(F.min("row").alias("row")).join(members.select("node").distinct(), "node", "left_semi")
    texts = settle(sets.select("node", "row", "packed").join(settle(firsts).select("row").hint("merge"), "row", "left_semi").drop("row"))

    alone = members.withColumn("root", F.col("node"))
    first = _centres(alone, F.lit(0).alias("rank"))
    found = settle(_verified(_pairs_with(first, alone), texts))

    # members beside the first centre that are still apart; two of them need no second look with that centre
    rest = _rooted(members.join(first.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti"), found)
    large = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_BUCKET).select("bucket")
    crowded = settle(rest.join(large, "bucket", "left_semi"))
    if not crowded.isEmpty():
        ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node")))
        degrees = settle(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
        ranked = crowded.join(degrees, "node", "left").withColumn("rank", -F.coalesce("degree", F.lit(0)))
        hubs = settle(_verified(_pairs_with(_centres(ranked, F.col("rank")), crowded), texts))
        found = settle(found.unionByName(hubs))
        rest = _rooted(rest.drop("root"), found)
    return found.unionByName(_verified_in_blocks(settle(_distinct_buckets(rest)), texts))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of similarity 0.8 or more, the row's own included. Texts without
    words (null, empty, blank) are linked with nothing, not even with each other. Rows that repeat an id keep their
    rows; null ids are never the smallest, and a component without ids has none: its rows are kept. Shingles are told apart by
    64 bits of hash, sets by 126. Chance decides only whether similar sets share a band, see above.
    """
    prints = settle(_prints(docs))
    filled = prints.where("n_shingles > 0")
    roots = components(settle(links(filled)))
    least = filled.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = settle(least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = settle(rooted.join(ids, "root").select("node", "component_id"))
    alone = prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = filled.select("doc_id", "n_shingles", "node").join(found, "node").select("doc_id", "n_shingles", "component_id")
    kept = F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
