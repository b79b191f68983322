"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Tokens are words and runs of other signs. Features are hashed single tokens, pairs of
neighbours, pairs of token shapes (words as a class, capitals as another, signs as themselves) and
the shares of repeated triples and doubled tokens. Values are square roots of shares, so texts of all lengths have the same
scale. A score is the sparse dot product of a text's features with the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm.common import batches_of, is_held_out, schema_of, with_row
from headroom.session import settle

BITS = 18
MOST_ROWS = 6_000  # labelled rows that are learned from
MOST_FEATURES = 6_000_000  # and their features, which the driver holds
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
THRESHOLD = 0.3
_TEXT_BYTES = 1 << 22

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
_IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_WORD, _CAPITALS, _REPEATS = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35


def _shares(hashes: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a kind of feature."""
    mixed = (hashes.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    places, counts = np.unique(mixed >> np.uint64(64 - BITS), return_counts=True)
    return places.astype(np.int32), np.sqrt(counts / max(1, len(hashes)), dtype=np.float32)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return hashes[:-1] * np.uint64(0x100000001B3) + hashes[1:]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text; an empty one has none."""
    tokens = _TOKEN.findall((text or "").encode())
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    count = len(tokens)
    hashes = np.fromiter(map(zlib.crc32, tokens), np.uint64, count)
    words = _IS_WORD[np.fromiter(map(itemgetter(0), tokens), np.uint8, count)]
    capitals = np.fromiter(map(bytes.isupper, tokens), bool, count) & (np.fromiter(map(len, tokens), np.int64, count) > 1)
    shapes = np.where(words, np.where(capitals, np.uint64(_CAPITALS), np.uint64(_WORD)), hashes)
    pairs = _pairs(hashes)
    parts = [_shares(hashes, 1), _shares(pairs, 2), _shares(_pairs(shapes), 3)]
    if count > 3:
        triples = pairs[:-1] * np.uint64(0x100000001B3) + hashes[2:]
        repeated = 1 - len(np.unique(triples)) / len(triples)
        doubled = np.mean(hashes[1:] == hashes[:-1])
        for salt, share in ((4, repeated), (5, doubled)):
            places, _ = _shares(np.array([_REPEATS], np.uint64), salt)
            parts.append((places, np.array([np.sqrt(share)], np.float32)))
    places, values = (np.concatenate(x) for x in zip(*parts))
    return places, values


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Follow-the-regularised-leader over ``(label, places, values)``, in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for label, places, values in rows:
            own_z, own_n = z[places], n[places]
            w = weights(own_z, own_n)
            gradient = (_sigmoid(float(w @ values)) - label) * values
            grown = own_n + gradient**2
            z[places] = own_z + gradient - (np.sqrt(grown) - np.sqrt(own_n)) / ALPHA * w
            n[places] = grown
    return weights(z, n).astype(np.float32)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES) -> np.ndarray:
    """Weights from a sample of labelled documents that are not held out.

    The sample is the ``most_rows`` ids of least hash, and of them, in the order of the hash, as many as have
    ``most_features`` features together (both bounds of the fit alone: scoring covers everything). Its features are
    extracted side by side and written before any are read. Of rows that repeat an id one text is learned from, the one of
    least hash. Rows without label or id are not learned from, nor are ids whose labels contradict each other.
    Without labels all weights are 0.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    known = known.where("label = other").select(F.col("doc_id").alias("known_id"), "label", F.xxhash64("doc_id").alias("place"))
    known = settle(known.orderBy("place", "known_id").limit(most_rows))  # rows of three numbers
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    rows = chosen.groupBy("label", "place", "known_id").agg(one.alias("one")).select("label", "place", "one.text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", _TEXT_BYTES):
                found = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("place"), pa.array([p.tobytes() for p, _ in found]), pa.array([v.tobytes() for _, v in found])],
                    ["label", "place", "places", "values"],
                )

    extracted = settle(rows.mapInArrow(extract, schema_of(rows, ["label", "place"], "places binary, values binary")))
    sizes = extracted.select("place", (F.length("places") / 4).cast("long").alias("size")).orderBy("place").collect()
    within = [row["place"] for row, total in zip(sizes, np.cumsum([row["size"] for row in sizes])) if total <= most_features]
    if not within:
        return train([])
    sample = extracted.where(F.col("place") <= within[-1]).orderBy("place").collect()
    return train([(int(row["label"]), np.frombuffer(row["places"], np.int32), np.frombuffer(row["values"], np.float32)) for row in sample])


def with_score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``row`` and ``score``, the probability of label 1; texts without tokens have 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS numbers, whatever the corpus
    rows = with_row(docs, "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in batches_of(batch, "text", _TEXT_BYTES):
                found = (features(t) for t in part.column("text").to_pylist())
                scores = [_sigmoid(float(w[places] @ values)) for places, values in found]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    return rows.mapInArrow(score, schema_of(rows, ["row"], "score double"))
