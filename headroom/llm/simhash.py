"""Near-duplicates by SimHash fingerprints and deletion variants.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in three bits or
fewer, one of the segments differs in one bit at most. Each segment is therefore
indexed under its 32 variants with one bit wiped out: segments that differ in that bit only,
or not at all, share a variant, so equality of variants finds every pair, and whole fingerprints
are then compared.

Variants that many distinct fingerprints share are refined by the same cut on the other
half: 16 + 16 bits, then 8 + 8. After that a bucket cannot hold more than a few thousand fingerprints,
as only that many exist; no bucket is capped. Inside a bucket a spanning forest of its
links is given out, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.common import batches_of, schema_of, with_row
from headroom.llm.components import components
from headroom.session import settle

SHINGLE = 3
SEED = 42
BITS = 64
DISTANCE = 3
MOST_IN_BUCKET = 2_000  # distinct fingerprints; larger buckets are refined, not cut off
FEW = 8  # up to here pairs are compared row against row, without a forest
_TEXT_BYTES = 1 << 22
_HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of lower-cased (A-Z) word shingles, repeats counted; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    count = len(words) - shingle + 1
    votes = np.zeros(BITS, np.int64)
    for begin in range(0, count, _HASHES):
        part = words[begin : begin + _HASHES + shingle - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(*[part[i:] for i in range(shingle)])], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """The rows with ``fingerprint``, a signed 64-bit number; null and empty texts have 0."""
    rows = with_row(docs, "text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", _TEXT_BYTES):
                prints = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(prints)], ["row", "fingerprint"])

    return rows.mapInArrow(add, schema_of(rows, ["row"], "fingerprint bigint"))


def _wiped(segment: Column, rest: Column, width: int, side: int) -> list[Column]:
    """Variants of a segment with one bit set to 0, told apart by side and place, each with the rest."""
    return [
        F.struct(
            segment.bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit((side * width + i) << width)).alias("key"),
            rest.alias("rest"),
        )
        for i in range(width)
    ]


def _halves(value: Column, width: int) -> tuple[Column, Column]:
    low = value.bitwiseAND(F.lit((1 << width) - 1))
    return F.shiftrightunsigned(value, width).bitwiseAND(F.lit((1 << width) - 1)), low


def _all_variants(value: Column, width: int) -> Column:
    high, low = _halves(value, width)
    return F.array(*_wiped(high, low, width, 0), *_wiped(low, high, width, 1))


def _variants(prints: DataFrame) -> DataFrame:
    """``key, fp, rest``: 64 variants; ``rest`` is the 32 bits outside the segment."""
    return prints.select("fp", F.explode(_all_variants(F.col("fp"), 32)).alias("v")).select("v.key", "fp", "v.rest")


def _refined(variants: DataFrame, width: int) -> DataFrame:
    """The same cut on what is left of a fingerprint; the new key covers old key and new variant.

    Keys are hashes here: if two of them clash, a bucket holds more candidates, none is lost.
    """
    exploded = variants.select("key", "fp", F.explode(_all_variants(F.col("rest"), width)).alias("v"))
    return exploded.select(F.xxhash64("key", F.lit(width), "v.key").alias("key"), "fp", "v.rest")


def forest(group: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among distinct fingerprints, one less than members each."""
    links, left = [], group
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            reached = np.zeros(len(left), bool)
            for one in frontier:
                near = ~reached & (np.bitwise_count(left ^ one) <= DISTANCE)
                links += [(int(one), int(other)) for other in left[near]]
                reached |= near
            frontier, left = left[reached], left[~reached]
    return links


def _bucket_links(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Links inside runs of equal keys; rows are sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    found = []
    size_of = np.repeat(sizes, sizes)
    small = size_of <= FEW
    for step in range(1, FEW):
        near = small[:-step] & (keys[:-step] == keys[step:])
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= DISTANCE]
        found.append(np.stack([prints[at], prints[at + step]], axis=1))
    for begin, size in zip(starts[sizes > FEW], sizes[sizes > FEW]):
        links = forest(np.unique(prints[begin : begin + size]))
        if links:
            found.append(np.array(links, np.uint64))
    links = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
    return links[links[:, 0] != links[:, 1]]


def _links_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets arrive whole and in order; the last one of a batch waits for the next batch."""
    rest_keys, rest_prints = [], []

    def out(links: np.ndarray) -> pa.RecordBatch:
        links = np.unique(links, axis=0)
        columns = [pa.array(np.ascontiguousarray(links[:, i]).view(np.int64)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, prints = (batch.column(c).to_numpy() for c in ("key", "fp"))
        prints = prints.view(np.uint64)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut or (rest_keys and rest_keys[-1][-1] != keys[0]):
            yield out(_bucket_links(np.concatenate([*rest_keys, keys[:cut]]), np.concatenate([*rest_prints, prints[:cut]])))
            rest_keys, rest_prints = [], []
        rest_keys.append(keys[cut:])
        rest_prints.append(prints[cut:])
    if rest_keys:
        yield out(_bucket_links(np.concatenate(rest_keys), np.concatenate(rest_prints)))


def _links_in_buckets(variants: DataFrame) -> DataFrame:
    ordered = variants.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_links_of_sorted, "a bigint, b bigint")


def links(prints: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Links ``a, b`` that connect whatever fingerprints within ``DISTANCE`` bits connect.

    ``prints`` has distinct ``fp``. Buckets of more than ``most`` members are refined twice; the last
    cut leaves 8 free bits and a few wiped ones, so its buckets are bounded by themselves.
    """
    found, level = [], _variants(prints)
    for width in (16, 8):
        crowded = settle(level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"))
        found.append(_links_in_buckets(level.join(crowded, "key", "left_anti")))
        level = _refined(level.join(crowded, "key", "left_semi"), width)
    found.append(_links_in_buckets(level))
    united = found[0].unionByName(found[1]).unionByName(found[2])
    return united.distinct()


def _grouped(docs: DataFrame, most: int) -> DataFrame:
    """``fingerprint, root, component_id`` next to all columns but ``text``; components are told apart by ``root``."""
    kept = [f"row.{c}" for c in docs.columns if c != "text"]
    prints = settle(with_fingerprint(docs).select(*kept, "fingerprint"))
    distinct = settle(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")))
    roots = components(settle(links(distinct.select("fp"), most)))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = settle(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = settle(rooted.join(ids, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id"))
    return prints.join(classes, "fingerprint")


def near_duplicates(docs: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id among all documents reachable over links, the
    document's own included. Texts without words (null, empty, blank) share fingerprint 0 and are linked
    like others. Rows that repeat an id keep their rows; null ids get results but are never
    the smallest id, unless a component has no other (then it is null).
    """
    return _grouped(docs.select("doc_id", "text"), most).select("doc_id", "fingerprint", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of rows of the group that repeat this id the one with the least hash stays, of the text first, then
    of the whole row. A group without any id keeps its different texts.
    """
    whole = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    found = _grouped(docs.select("doc_id", "text", F.xxhash64("text").alias("own"), whole.alias("whole")), MOST_IN_BUCKET)
    least = found.where(F.col("doc_id") == F.col("component_id")).groupBy("root", "doc_id").agg(F.min(F.struct("own", "whole")).alias("least"))
    stay = least.select(F.col("doc_id").alias("stay_id"), F.col("least.own").alias("stay_own"), F.col("least.whole").alias("stay_whole"))
    rows = with_row(docs, "doc_id").where("doc_id IS NOT NULL")
    rows = rows.withColumns({"own": F.xxhash64("row.text"), "whole": F.xxhash64("row")})
    same = (F.col("doc_id") == F.col("stay_id")) & (F.col("own") == F.col("stay_own")) & (F.col("whole") == F.col("stay_whole"))
    named = rows.join(stay, same, "left_semi").dropDuplicates(["doc_id", "own", "whole"]).select("row")
    alone = found.where("doc_id IS NULL AND component_id IS NULL").select(F.col("fingerprint").alias("stay_print"))
    nameless = with_fingerprint(docs.where("doc_id IS NULL")).join(alone, F.col("fingerprint") == F.col("stay_print"), "left_semi")
    nameless = nameless.withColumn("own", F.md5("row.text")).dropDuplicates(["own"]).select("row")
    return named.unionByName(nameless).select("row.*")
