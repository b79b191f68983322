"""Benchmark decontamination as a prefix-filtered containment join.

The items of a benchmark are cut into windows of ten words (shorter items are one window). A
document holds a window only if it holds all its words, so one word is a sufficient prefix: the
rarest, by its count over all documents. The join meets documents and windows on that word alone;
the word's place in the window fixes where the window would begin, which the length of the document
bounds; the remaining words are compared from rare to frequent until none is left.

The item side is read in blocks of bounded size. Each block is one pass over the documents, which
are never shuffled; hits of several blocks are merged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm.common import batches_of, schema_of, with_row
from headroom.session import settle

WINDOW = 10
BLOCK_CHARS = 8_000_000  # of item texts held in a task at a time
_TEXT_BYTES = 1 << 22

#: Bytes outside words become blanks, A-Z become a-z; bytes of other letters stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _codes(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))


class Windows:
    """Windows of a block of items: words as numbers, and which items have each window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        """``items``: pairs of id and text; rows of the same id are one item."""
        self.ids = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for begin in range(max(1, len(codes) - window + 1) if codes else 0):
                owners.setdefault(tuple(codes[begin : begin + window]), set()).add(number[name])
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.words = np.full((len(owners), window), -1, np.int32)
        for i, w in enumerate(owners):
            self.words[i, : len(w)] = w
        self.owner_starts = np.cumsum([0, *map(len, owners.values())])
        self.owners = np.array([o for own in owners.values() for o in sorted(own)], np.int64)

    def order_by_rarity(self, counts: np.ndarray) -> None:
        """Places of each window's words from rare to frequent, and windows by their rarest word."""
        rank = np.where(self.words >= 0, counts[self.words], np.iinfo(np.int64).max)
        self.places = np.argsort(rank, axis=1, kind="stable")
        rarest = self.words[np.arange(len(self.words)), self.places[:, 0]] if len(self.words) else np.zeros(0, np.int32)
        self.by_rarest = np.argsort(rarest, kind="stable")
        self.starts = np.searchsorted(rarest[self.by_rarest], np.arange(len(self.vocabulary) + 1))

    def find(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of every window found in ``codes``; ``begins, ends`` bound the document of each code."""
        at = np.flatnonzero(codes >= 0)
        first, last = self.starts[codes[at]], self.starts[codes[at] + 1]
        some = last > first
        at, first, many = at[some], first[some], (last - first)[some]
        window = self.by_rarest[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
        at = np.repeat(at, many)
        begin = at - self.places[window, 0]
        fits = (begin >= begins[at]) & (begin + self.lengths[window] <= ends[at])
        begin, window = begin[fits], window[fits]
        for nth in range(1, self.words.shape[1]):
            place = self.places[window, nth]
            inside = nth < self.lengths[window]
            same = ~inside
            same[inside] = codes[begin[inside] + place[inside]] == self.words[window[inside], place[inside]]
            begin, window = begin[same], window[same]
        return begin, window


def _word_counts(docs: DataFrame, windows: Windows) -> np.ndarray:
    """How often each word of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(windows.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                codes = _codes(words_of(text), vocabulary)
                total += np.bincount(codes[codes >= 0], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    parts = docs.select("text").mapInArrow(count, "word bigint, n bigint")
    counts = np.zeros(len(windows.vocabulary), np.int64)
    for row in parts.groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["word"]] = row["n"]
    shared.unpersist()
    return counts


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or adjoining spans (begin, end) as one, in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    opens = np.r_[True, spans[1:, 0] > reach[:-1]]
    closes = np.r_[np.flatnonzero(opens)[1:] - 1, len(spans) - 1]
    return np.stack([spans[opens, 0], reach[closes]], axis=1)


_FOUND = "n_words bigint, spans array<struct<begin: bigint, end: bigint>>, items array<string>"


def _scan(docs: DataFrame, windows: Windows) -> DataFrame:
    """Adds what the windows of a block hit to ``spans`` and ``items``."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Windows = shared.value
        for batch in batches:
            for part in batches_of(batch, "text", _TEXT_BYTES):
                texts = [words_of(t) for t in part.column("text").to_pylist()]
                sizes = np.array([len(t) for t in texts])
                bounds = np.cumsum(np.r_[0, sizes])
                codes = _codes([w for t in texts for w in t], block.vocabulary)
                rows = np.repeat(np.arange(len(texts)), sizes)
                begin, window = block.find(codes, bounds[rows], bounds[rows + 1] if len(rows) else rows)
                row = rows[begin]
                order = np.argsort(row, kind="stable")
                begin, window, row = begin[order], window[order], row[order]
                cuts = np.searchsorted(row, np.arange(len(texts) + 1))
                spans, items = part.column("spans").to_pylist(), part.column("items").to_pylist()
                for i in np.unique(row):
                    own = slice(cuts[i], cuts[i + 1])
                    found = np.stack([begin[own], begin[own] + block.lengths[window[own]]], axis=1) - bounds[i]
                    before = np.array([(s["begin"], s["end"]) for s in spans[i]], np.int64).reshape(-1, 2)
                    spans[i] = [{"begin": int(a), "end": int(b)} for a, b in merged(np.concatenate([before, found]))]
                    owners = {int(o) for w in np.unique(window[own]) for o in block.owners[block.owner_starts[w] : block.owner_starts[w + 1]]}
                    items[i] = sorted({*items[i], *(block.ids[o] for o in owners)})
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), pa.array(sizes, pa.int64()),
                     pa.array(spans, batch.schema.field("spans").type), pa.array(items, pa.list_(pa.string()))],
                    ["row", "text", "n_words", "spans", "items"],
                )

    return docs.mapInArrow(scan, schema_of(docs, ["row"], f"text string, {_FOUND}"))


def with_hits(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row`` (the document as it came), ``n_words``, ``spans`` of hit words and ``items`` found.

    Words are runs of letters, digits and anything beyond ASCII, lower-cased for A-Z. Null texts
    have no words. Benchmark rows without id or words are no items; rows that repeat an id are one
    item with all their windows; of equal texts under several ids every id is found. ``items`` holds
    ids as strings, in string order.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("id"), "text")
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    rows = with_row(docs, "text").selectExpr(
        "row", "text", "CAST(0 AS BIGINT) AS n_words", "CAST(array() AS array<struct<begin: bigint, end: bigint>>) AS spans", "CAST(array() AS array<string>) AS items"
    )
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        windows = Windows([(r["id"], r["text"]) for r in own.toLocalIterator()])
        windows.order_by_rarity(_word_counts(docs, windows))
        rows = _scan(rows, windows)
        if block < blocks - 1:  # one block in memory at a time
            rows = settle(rows)
    return rows.select("row", "n_words", "spans", "items")


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs, as they came."""
    return with_hits(docs, benchmark).where(F.size("spans") == 0).select("row.*")
