"""Substring deduplication by difference-cover anchors.

Of every 13 positions of a document four are in the cover {0, 1, 3, 9}, whose differences give
every number modulo 13. Two equal windows of 20 words, wherever they begin, therefore have a
place within their first 13 words where both are in the cover, and the 8 words from there on are an anchor
that both have. Only anchors are hashed and shuffled, three tenths of all positions.

Each anchor is extended by the words around it that windows over it can reach. Occurrences of one
anchor with the same surroundings are one class: all windows over a later member repeat the first
member's. Where an anchor has several classes, a match ends nearby; there the windows themselves
are compared, of the first member of each class.

Repeats inside a batch are settled before the shuffle, and an anchor that has many classes in a batch
is sent on as two rows, with its windows to be compared. So a passage that a third of all documents
has sends a few rows per batch, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm.common import PLACE_BITS, batches_of, covered, mixed, numbered, rolled, unpack, with_packed_text
from headroom.session import settle

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
OPEN, REPEAT, COMPARE = 0, 1, 2  # what is known of an anchor
HOT = 16  # classes of an anchor in one batch
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_TEXT_BYTES = 1 << 22
_ROWS_OUT = 1 << 16


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of its surroundings, and place, of every anchor of a document of 20 words or more."""
    places = np.arange(len(hashes) - ANCHOR + 1)
    places = places[np.isin(places % PERIOD, COVER)]
    anchors = mixed(rolled(hashes, ANCHOR, _BASE)[places])
    reach = PERIOD - 1
    # beyond both ends stands a value that no word has, so that places near them differ
    padded = np.concatenate([np.arange(1, reach + 1, dtype=np.uint64), hashes, np.arange(101, 101 + WINDOW, dtype=np.uint64)])
    around = mixed(rolled(padded, reach + WINDOW, _OTHER)[places])
    return anchors, around, places


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for key in keys:
        first[1:] |= key[1:] != key[:-1]
    return first


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


_ANCHOR_ROW = ["anchor", "around", "doc", "place"]


def _send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``anchor, around, doc, place``; the lowest two bits of ``place`` say what is known."""
    for batch in batches:
        for part in batches_of(batch, "text", _TEXT_BYTES):
            found = []
            for doc, tie, text in zip(*(part.column(c).to_pylist() for c in ("doc", "tie", "text"))):
                words = text.encode().split()
                if len(words) >= WINDOW:
                    anchors, around, places = _anchors(_word_hashes(words))
                    found.append((anchors, around, np.full(len(places), doc), places + (tie << PLACE_BITS)))
            if found:
                rows = _settled_in_batch(*(np.concatenate(c) for c in zip(*found)))
                for begin in range(0, len(rows[0]), _ROWS_OUT):
                    own = [c[begin : begin + _ROWS_OUT] for c in rows]
                    yield pa.RecordBatch.from_arrays([_signed(own[0]), _signed(own[1]), pa.array(own[2]), pa.array(own[3])], _ANCHOR_ROW)


def _settled_in_batch(anchors, around, docs, places) -> tuple:
    """What a batch knows by itself, so that frequent passages send few rows."""
    order = np.lexsort((places, docs, around, anchors))
    order = order[_first_of_runs(anchors[order], around[order], docs[order], places[order])]  # a row given twice
    anchors, around, docs, places = anchors[order], around[order], docs[order], places[order]
    new_anchor = _first_of_runs(anchors)
    new_class = new_anchor | _first_of_runs(around)
    number = np.cumsum(new_anchor) - 1
    classes = np.bincount(number[new_class], minlength=number[-1] + 1)
    hot = classes[number] >= HOT
    state = np.where(~new_class, REPEAT, np.where(hot, COMPARE, OPEN))
    known = state != OPEN
    # decided rows travel on their own; an anchor hot here leaves two rows of different classes for other batches to meet
    keys = np.where(known, mixed(docs.astype(np.uint64) * np.uint64(_BASE) + places.astype(np.uint64)), anchors)
    stand_in = np.flatnonzero(hot & new_anchor)
    return (
        np.concatenate([keys, anchors[stand_in], anchors[stand_in]]),
        np.concatenate([around, around[stand_in], ~keys[stand_in]]),
        np.concatenate([docs, docs[stand_in], docs[stand_in]]),
        np.concatenate([places * 4 + state, places[stand_in] * 4, places[stand_in] * 4]),
    )


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, place`` of anchors that repeat or whose windows are to be compared.

    Rows arrive by anchor, class, document and place. Of an open anchor the first
    row of its first class waits until a second class is seen.
    """
    anchor = around = waiting = None
    classes = 0
    for a, c, docs, places in _different_rows(batches):
        state = places & 3
        decided = state != OPEN
        out = [(docs[decided], places[decided])]
        a, c, docs, places = (x[~decided] for x in (a, c, docs, places))
        if len(a):
            new_anchor = _first_of_runs(a)
            new_class = new_anchor | _first_of_runs(c)
            goes_on = anchor is not None and a[0] == anchor
            if goes_on:
                new_anchor[0], new_class[0] = False, c[0] != around
            number = np.cumsum(new_anchor)  # 0: the anchor that was open before
            count = np.bincount(number[new_class], minlength=number[-1] + 1)
            count[0] += classes if goes_on else 0
            several = count[number] > 1
            if goes_on and waiting is not None and count[0] > 1:
                out.append(waiting)
                waiting = None
            out.append((docs[~new_class], places[~new_class] + REPEAT))
            compare = new_class & several
            out.append((docs[compare], places[compare] + COMPARE))
            last = number == number[-1]
            if number[-1] > 0 or not goes_on:
                waiting = None
                if count[number[-1]] == 1:
                    at = np.flatnonzero(last & new_class)[:1]
                    waiting = (docs[at], places[at] + COMPARE)
            anchor, around, classes = a[-1], c[-1], int(count[number[-1]])
        docs, places = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(places)], ["doc", "place"])


def _different_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted rows as arrays, each row once: a document that is given twice is one document."""
    before = None
    for batch in batches:
        rows = [batch.column(name).to_numpy() for name in _ANCHOR_ROW]
        if not batch.num_rows:
            continue
        own = _first_of_runs(*rows)
        if before is not None and tuple(x[0] for x in rows) == before:
            own[0] = False
        before = tuple(x[-1] for x in rows)
        yield tuple(x[own] for x in rows)


def _per_document(found: DataFrame) -> DataFrame:
    """``doc, tie, places`` of rows ``doc, place``; ``places`` without the tie."""
    tie = F.shiftright("place", PLACE_BITS + 2)
    place = F.col("place").bitwiseAND(F.lit((1 << (PLACE_BITS + 2)) - 1))
    return found.select("doc", tie.alias("tie"), place.alias("place")).groupBy("doc", "tie").agg(F.collect_list("place").alias("places"))


def _window_bounds(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window over each anchor, of a document of ``size`` words."""
    return np.maximum(places - PERIOD + 1, 0), np.minimum(places, size - WINDOW)


def _send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two independent hashes, document and place, of the windows to be compared."""
    for batch in batches:
        for part in batches_of(batch, "packed", _TEXT_BYTES // 3):
            found = []
            for doc, tie, blob, places in zip(*(part.column(c).to_pylist() for c in ("doc", "tie", "packed", "places"))):
                places = np.array(places, np.int64)
                anchors = places[places & 3 == COMPARE] >> 2
                if not len(anchors):
                    continue
                hashes = _word_hashes(unpack(blob).split())
                first, last = _window_bounds(anchors, len(hashes))
                windows = np.flatnonzero(covered(first, last + 1, len(hashes) - WINDOW + 1))
                one, two = (mixed(rolled(hashes, WINDOW, base)[windows]) for base in (_BASE, _OTHER))
                found.append((one, two, np.full(len(windows), doc), windows + (tie << PLACE_BITS)))
            if found:
                one, two, docs, places = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((places, docs, two, one))
                order = order[_first_of_runs(one[order], docs[order], places[order])]
                one, two, docs, places = one[order], two[order], docs[order], places[order]
                later = ~_first_of_runs(one, two)
                one[later] = mixed(docs[later].astype(np.uint64) + places[later].astype(np.uint64))
                places = places * 4 + np.where(later, REPEAT, OPEN)
                for begin in range(0, len(one), _ROWS_OUT):
                    own = slice(begin, begin + _ROWS_OUT)
                    yield pa.RecordBatch.from_arrays([_signed(one[own]), _signed(two[own]), pa.array(docs[own]), pa.array(places[own])], _ANCHOR_ROW)


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, place`` of all windows but the first of each kind."""
    before = None
    for one, two, docs, places in _different_rows(batches):
        decided = places & 3 == REPEAT
        first = _first_of_runs(one[~decided], two[~decided])
        if before is not None and len(first):
            first[0] = (one[~decided][0], two[~decided][0]) != before
        if len(first):
            before = (one[~decided][-1], two[~decided][-1])
        repeat = decided.copy()
        repeat[np.flatnonzero(~decided)[~first]] = True
        yield pa.RecordBatch.from_arrays([pa.array(docs[repeat]), pa.array(places[repeat] | 3)], ["doc", "place"])


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("anchor").sortWithinPartitions(*_ANCHOR_ROW)


_KEYS = "anchor bigint, around bigint, doc bigint, place bigint"


def repeated(docs: DataFrame) -> DataFrame:
    """``doc, tie, places``: what repeats in each document of ``numbered(docs)`` that repeats anything.

    A place ends in two bits: 1 after an anchor whose windows all repeat, 3 after a window that does.
    """
    anchors = docs.select("doc", "tie", "text").mapInArrow(_send_anchors, _KEYS)
    found = settle(_per_document(_met(anchors).mapInArrow(_decide, "doc bigint, place bigint")))
    compare = found.where(F.exists("places", lambda p: p.bitwiseAND(F.lit(3)) == COMPARE))
    texts = with_packed_text(docs.select("doc", "tie", "text"))
    windows = texts.join(compare, ["doc", "tie"]).mapInArrow(_send_windows, _KEYS)
    later = settle(_per_document(_met(windows).mapInArrow(_repeated_windows, "doc bigint, place bigint")))
    both = found.join(later.withColumnRenamed("places", "windows"), ["doc", "tie"], "left")
    return both.select("doc", "tie", F.concat("places", F.coalesce("windows", F.array().cast("array<bigint>"))).alias("places"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batches_of(batch, "packed", _TEXT_BYTES // 3):
            out = []
            for blob, places in zip(part.column("packed").to_pylist(), part.column("places").to_pylist()):
                words = unpack(blob).split()
                places = np.array(places or [], np.int64)
                first, last = _window_bounds(places[places & 3 == REPEAT] >> 2, len(words))
                windows = places[places & 3 == 3] >> 2
                begins, ends = np.r_[first, windows], np.r_[last + WINDOW, windows + WINDOW]
                gone = covered(begins, ends, len(words))
                kept = [words[i] for i in np.flatnonzero(~gone)] if len(begins) else words
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            counts = [pa.array([row[i] for row in out], pa.int64()) for i in (0, 1)]
            hashes = pa.array([hashlib.sha256(row[2]).hexdigest() for row in out])
            kept = pa.array([row[2].decode() for row in out])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, kept, hashes], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def without_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` for every row of ``docs``.

    Every word is removed that lies in a window of 20 words whose like begins earlier: in a smaller
    id, or further up in the same text. Rows of equal id and text are one document and get the same
    result; different texts of one id come in the order of their hash. Null texts have no words. ``kept``
    is left out on request.
    """
    rows = numbered(docs)
    found = repeated(rows)
    joined = with_packed_text(rows).join(found, ["doc", "tie"], "left").select("doc_id", "packed", "places")
    kind = joined.schema["doc_id"].dataType.simpleString()
    out = joined.mapInArrow(_removed, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
    return out if keep_text else out.drop("kept")
