"""Repeated byte strings by run-length indexes over the places where repeats can end.

Every window of 400 bytes holds 369 runs of 32 bytes; the one with the least hash is its anchor. Equal
windows have the same anchor at the same place, so they meet under its hash. Neighbouring windows
share anchors: a document becomes a row of stretches of windows, each with an anchor and the text
its windows cover, and every window lies in exactly one stretch.

Stretches of equal text repeat as a whole. Where one anchor has stretches of different text, a match ends
somewhere inside them: one of each kind goes, with its text, into a run-length index
(`run_length_index`), whose matching statistics tell which of its windows occur elsewhere. The index of a
task covers some groups at a time, so its size is bounded.

An anchor with very many stretches (a passage that a third of all documents have) would be too large a
group. Repeats inside a batch are settled before the shuffle, and the windows of such an
anchor are compared one by one, by 128 bits of hash, which spreads them over all tasks.
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
from headroom.llm.run_length_index import RunLengthIndex
from headroom.session import settle

WINDOW, GRAM = 400, 32
HOT_CLASSES = 16  # different stretches of an anchor in one batch
HOT_ROWS = 1_000  # stretches of an anchor that may meet in one task
INDEX_BYTES = 400_000  # an index is built from here on, with one group more at most
OPEN, REPEAT, INDEX, PARTNER, HOT, MARK = range(6)  # what is known of a stretch
_STATE_BITS = 3
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_TEXT_BYTES = 1 << 21
_BLOCK = 1 << 18  # windows looked at together
_ROWS_OUT = 1 << 15
_ORDINAL = np.uint64((1 << 20) - 1)


def _stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, place of the anchor, first window and number of windows, in order."""
    found = []
    reach = WINDOW - GRAM + 1
    for begin in range(0, len(data) - WINDOW + 1, _BLOCK):
        part = data[begin : begin + _BLOCK + WINDOW - 1]
        hashes = mixed(rolled(part, GRAM, _BASE))
        least = (hashes & ~_ORDINAL) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        anchor = (least & _ORDINAL).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[first, len(anchor)])
        at = anchor[first]
        found.append((hashes[at], at + begin, first + begin, count))
    return tuple(np.concatenate(x) for x in zip(*found))


_ROW = ["anchor", "one", "two", "doc", "place", "count"]
_ROW_KIND = "anchor bigint, one bigint, two bigint, doc bigint, place bigint, count bigint"


def _out(rows: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for begin in range(0, len(rows[0]), _ROWS_OUT):
        own = [pa.array(np.ascontiguousarray(c[begin : begin + _ROWS_OUT]).view(np.int64)) for c in rows]
        yield pa.RecordBatch.from_arrays(own, names)


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for key in keys:
        first[1:] |= key[1:] != key[:-1]
    return first


def _alone(docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys of rows that need not meet any other."""
    return mixed(docs.astype(np.uint64) * np.uint64(_BASE) + places.astype(np.uint64))


def _send_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batches_of(batch, "text", _TEXT_BYTES):
            found = []
            for doc, tie, text in zip(*(part.column(c).to_pylist() for c in ("doc", "tie", "text"))):
                raw = text.encode()
                if len(raw) < WINDOW:
                    continue
                anchors, at, first, count = _stretches(np.frombuffer(raw, np.uint8))
                ends = first + count + WINDOW - 1
                digest = xxhash.xxh3_128_digest
                texts = np.frombuffer(
                    b"".join(digest(raw[a:b], m - a) for a, b, m in zip(first.tolist(), ends.tolist(), at.tolist())), np.uint64
                ).reshape(-1, 2)
                found.append((anchors, texts[:, 0], texts[:, 1], np.full(len(first), doc), first + (tie << PLACE_BITS), count))
            if found:
                yield from _out(_settled_in_batch(*(np.concatenate(c) for c in zip(*found))), _ROW)


def _settled_in_batch(anchors, one, two, docs, places, counts) -> list[np.ndarray]:
    """What a batch knows by itself, so that frequent passages send few rows."""
    order = np.lexsort((places, docs, two, one, anchors))
    order = order[_first_of_runs(*(x[order] for x in (anchors, one, two, docs, places)))]  # a document given twice
    anchors, one, two, docs, places, counts = (x[order] for x in (anchors, one, two, docs, places, counts))
    new_anchor = _first_of_runs(anchors)
    new_class = new_anchor | _first_of_runs(one, two)
    number, kind = np.cumsum(new_anchor) - 1, np.cumsum(new_class) - 1
    classes = np.bincount(number[new_class], minlength=number[-1] + 1)
    several = np.bincount(kind)[kind] > 1
    hot = classes[number] >= HOT_CLASSES
    rows = []

    def add(chosen, state, keys):
        rows.append((keys, one[chosen], two[chosen], docs[chosen], (places[chosen] << _STATE_BITS) + state, counts[chosen]))

    add(several, REPEAT, _alone(docs[several], places[several]))
    first = new_class & hot
    add(first, HOT, ~_alone(docs[first], places[first]))
    first = new_class & ~hot
    add(first, OPEN, anchors[first])
    first = hot & new_anchor
    add(first, MARK, anchors[first])
    return [np.concatenate(c).astype(np.int64) if i > 2 else np.concatenate(c) for i, c in enumerate(zip(*rows))]


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Rows sorted by their first column, whole groups at a time.

    A group of more than ``most`` rows comes in parts, which say so; nothing larger waits here.
    """
    waiting, held, key, over = [], 0, None, False

    def rest() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*waiting)]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if key is not None and rows[0][0] == key:
            stay = int(np.searchsorted(rows[0], key, side="right"))
            waiting.append([c[:stay] for c in rows])
            held += stay
            rows = [c[stay:] for c in rows]
        if len(rows[0]):
            if waiting:
                yield rest(), over
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            if cut:
                yield [c[:cut] for c in rows], False
            waiting, key, over = [[c[cut:] for c in rows]], rows[0][-1], False
            held = len(waiting[0][0])
        if held > most:
            yield rest(), True
            waiting, held, over = [], 0, True
    if waiting:
        yield rest(), over


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``anchor, doc, place, count`` of stretches that repeat or have to be looked at, with what to do in ``place``."""
    for rows, over in _groups(batches, HOT_ROWS):
        state = rows[4] & ((1 << _STATE_BITS) - 1)
        out = []

        def add(chosen, kind, rows):
            out.append((rows[0][chosen], rows[3][chosen], rows[4][chosen] + kind, rows[5][chosen]))

        add(np.isin(state, (REPEAT, HOT)), 0, rows)
        marked = np.unique(rows[0][state == MARK])
        rows = [c[state == OPEN] for c in rows]
        rows = [c[_first_of_runs(*rows[:5])] for c in rows]
        if len(rows[0]):
            new_anchor = _first_of_runs(rows[0])
            new_class = new_anchor | _first_of_runs(rows[1], rows[2])
            number, kind = np.cumsum(new_anchor) - 1, np.cumsum(new_class) - 1
            many = (np.bincount(number[new_class]) > 1)[number]
            several = (np.bincount(kind) > 1)[kind]
            crowded = (np.bincount(number) > HOT_ROWS)[number]  # also where the batch holds the whole group
            hot = np.isin(rows[0], marked) | crowded | over
            add(several, REPEAT, rows)
            add(new_class & hot, HOT, rows)
            add(new_class & ~hot & many & ~several, INDEX, rows)
            add(new_class & ~hot & many & several, PARTNER, rows)
        yield from _out([np.concatenate(c) for c in zip(*out)], ["anchor", "doc", "place", "count"])


def _per_document(found: DataFrame) -> DataFrame:
    """``doc, tie, parts``: what was found in each document; places without the tie."""
    low = F.lit((1 << (PLACE_BITS + _STATE_BITS)) - 1)
    part = F.struct(F.col("place").bitwiseAND(low).alias("place"), "count", "anchor")
    tie = F.shiftright("place", PLACE_BITS + _STATE_BITS)
    return found.select("doc", tie.alias("tie"), part.alias("part")).groupBy("doc", "tie").agg(F.collect_list("part").alias("parts"))


def _send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of stretches for the indexes, under their anchor, and hashes of windows of hot anchors."""
    for batch in batches:
        for part in batches_of(batch, "packed", _TEXT_BYTES // 3):
            texts, windows = [], []
            for doc, tie, blob, parts in zip(*(part.column(c).to_pylist() for c in ("doc", "tie", "packed", "parts"))):
                raw = unpack(blob)
                for found in parts:
                    state, first = found["place"] & ((1 << _STATE_BITS) - 1), found["place"] >> _STATE_BITS
                    place = first + (tie << PLACE_BITS)
                    body = raw[first : first + found["count"] + WINDOW - 1]
                    if state in (INDEX, PARTNER):
                        texts.append((found["anchor"], 0, 0, doc, (place << _STATE_BITS) + state, found["count"], body))
                    elif state == HOT:
                        data = np.frombuffer(body, np.uint8).astype(np.uint64) + np.uint64(1)
                        one, two = (mixed(rolled(mixed(data), WINDOW, base)) for base in (_BASE, _OTHER))
                        windows.append((one, two, np.full(len(one), doc), np.arange(len(one)) + place))
            if texts:
                columns = list(zip(*texts))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], [*_ROW, "body"])
            if windows:
                one, two, docs, places = (np.concatenate(c) for c in zip(*windows))
                order = np.lexsort((places, docs, two, one))
                order = order[_first_of_runs(*(x[order] for x in (one, two, docs, places)))]
                one, two, docs, places = one[order], two[order], docs[order], places[order]
                new = _first_of_runs(one, two)
                kind = np.cumsum(new) - 1
                several = (np.bincount(kind) > 1)[kind]
                keys = np.concatenate([one[new], _alone(docs[several], places[several])])
                states = np.r_[np.full(new.sum(), HOT), np.full(several.sum(), REPEAT)]
                docs, places, two = (np.concatenate([c[new], c[several]]) for c in (docs, places, two))
                rows = [keys, np.zeros(len(keys), np.int64), two, docs, (places << _STATE_BITS) + states, np.ones(len(keys), np.int64)]
                for out in _out(rows, _ROW):
                    yield out.append_column("body", pa.nulls(out.num_rows, pa.binary()))


class _Shard:
    """Stretches waiting for an index."""

    def __init__(self):
        self.bodies, self.rows, self.size = [], [], 0

    def add(self, docs, places, counts, bodies) -> None:
        self.bodies += list(bodies)
        self.rows += list(zip(docs.tolist(), places.tolist(), counts.tolist()))
        self.size += sum(map(len, bodies))

    def release(self) -> list[tuple[int, int, int]]:
        """Runs of windows that occur elsewhere, of the stretches that are not mere partners."""
        longest = RunLengthIndex(self.bodies).matching_statistics()
        out, begin = [], 0
        for body, (doc, place, count) in zip(self.bodies, self.rows):
            hit = longest[begin : begin + count] >= WINDOW
            begin += len(body)
            if place & ((1 << _STATE_BITS) - 1) == INDEX and hit.any():
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                for a, b in edges.reshape(-1, 2).tolist():
                    out.append((doc, (((place >> _STATE_BITS) + a) << _STATE_BITS) + REPEAT, b - a))
        self.__init__()
        return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``anchor, doc, place, count`` of windows that occur elsewhere."""
    names = ["anchor", "doc", "place", "count"]
    shard, last, anchor = _Shard(), None, None

    def runs(found: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            columns = [np.array(c, np.int64) for c in zip(*found)]
            yield from _out([np.zeros(len(found), np.int64), *columns], names)

    for rows, _ in _groups(batches, HOT_ROWS):
        state = rows[4] & ((1 << _STATE_BITS) - 1)
        text = np.isin(state, (INDEX, PARTNER))
        if text.any():
            own = [c[text] for c in rows]
            own = [c[_first_of_runs(own[0], own[3], own[4])] for c in own]
            if own[0][0] != anchor:  # an anchor's parts stay in one index
                if shard.size >= INDEX_BYTES:
                    yield from runs(shard.release())
            elif shard.rows[-1][:2] == (own[3][0], own[4][0]):  # a document given twice, at the end of a part
                own = [c[1:] for c in own]
            anchor = rows[0][text][-1]
            shard.add(own[3], own[4], own[5], own[6])
        out = [tuple(rows[i][state == REPEAT] for i in (3, 4))]
        rows = [c[state == HOT] for c in rows]
        rows = [c[_first_of_runs(*rows[:5])] for c in rows]
        if len(rows[0]):
            new = _first_of_runs(rows[0], rows[2])
            kind = np.cumsum(new) - 1
            several = (np.bincount(kind) > 1)[kind]
            first = tuple(c[0] for c in rows[:5])
            if last is not None and (first[0], first[2]) == (last[0], last[2]) and first[3:] != last[3:]:
                several |= kind == 0  # the same window as the last of the part before
                out.append((np.array([last[3]]), np.array([last[4]]) - HOT + REPEAT))
            last = tuple(c[-1] for c in rows[:5])
            out.append((rows[3][several], rows[4][several] - HOT + REPEAT))
        docs, places = (np.concatenate(c) for c in zip(*out))
        yield from _out([np.zeros(len(docs), np.int64), docs, places, np.ones(len(docs), np.int64)], names)
    if shard.size:
        yield from runs(shard.release())


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("anchor").sortWithinPartitions(*_ROW[:5])


_FOUND_KIND = "anchor bigint, doc bigint, place bigint, count bigint"


def repeated(docs: DataFrame) -> DataFrame:
    """``doc, tie, parts`` for each document of ``numbered(docs)`` that holds a repeat."""
    stretches = docs.select("doc", "tie", "text").mapInArrow(_send_stretches, _ROW_KIND)
    found = settle(_per_document(_met(stretches).mapInArrow(_decide, _FOUND_KIND)))

    def state(part):
        return part["place"].bitwiseAND(F.lit((1 << _STATE_BITS) - 1))

    look = found.select("doc", "tie", F.filter("parts", lambda p: state(p) != REPEAT).alias("parts")).where(F.size("parts") > 0)
    texts = with_packed_text(docs.select("doc", "tie", "text")).join(look, ["doc", "tie"])
    matched = _met(texts.mapInArrow(_send_texts, f"{_ROW_KIND}, body binary")).mapInArrow(_match, _FOUND_KIND)
    matched = settle(_per_document(matched))
    sure = found.select("doc", "tie", F.filter("parts", lambda p: state(p) == REPEAT).alias("parts")).where(F.size("parts") > 0)
    both = sure.unionByName(matched).groupBy("doc", "tie").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    return both.select("doc", "tie", F.transform("parts", lambda p: F.struct(p["place"].alias("place"), p["count"].alias("count"))).alias("parts"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batches_of(batch, "packed", _TEXT_BYTES // 3):
            out = []
            for blob, parts in zip(part.column("packed").to_pylist(), part.column("parts")):
                raw = unpack(blob)
                kept, gone, spans = raw, 0, 0
                if parts.is_valid and len(parts):
                    first = parts.values.field("place").to_numpy() >> _STATE_BITS
                    hit = covered(first, first + parts.values.field("count").to_numpy() + WINDOW - 1, len(raw))
                    kept = np.frombuffer(raw, np.uint8)[~hit].tobytes()
                    gone = int(hit.sum())
                    spans = int(np.count_nonzero(np.diff(np.r_[False, hit].astype(np.int8)) == 1))
                out.append((len(raw), gone, spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [()] * 5
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *_RESULT])


_RESULT = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]


def without_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` for every row of ``docs``.

    Every byte is removed that lies in a string of 400 bytes which also begins anywhere else, in the
    same text or another. Rows of equal id and text are one document: neither is elsewhere
    for the other, and both get the same result. Null texts are empty. ``kept`` (bytes, since a cut may fall
    inside a character) is left out on request.
    """
    rows = numbered(docs)
    found = repeated(rows)
    joined = with_packed_text(rows).join(found, ["doc", "tie"], "left").select("doc_id", "packed", "parts")
    kind = joined.schema["doc_id"].dataType.simpleString()
    out = joined.mapInArrow(_removed, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
    return out if keep_bytes else out.drop("kept")
