from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from headroom.llm import repeated_bytes
from headroom.llm.run_length_index import RunLengthIndex


def brute(docs):
    """Every window of 400 bytes counted; ``docs`` is a list of (id, text)."""
    raws = [(t or "").encode() for _, t in docs]
    counts = Counter(raw[p : p + 400] for raw in raws for p in range(len(raw) - 399))
    out = []
    for (doc_id, _), raw in zip(docs, raws):
        hit = [False] * len(raw)
        for p in range(len(raw) - 399):
            if counts[raw[p : p + 400]] > 1:
                hit[p : p + 400] = [True] * 400
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        spans = sum(h and not g for h, g in zip(hit, [False, *hit]))
        out.append((doc_id, len(raw), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def passages(seed, count):
    rng = random.Random(seed)
    letters = "abcdefgé "
    pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(380, 900))) for _ in range(5)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.random()
            if kind < 0.6:
                part = rng.choice(pool)
                if rng.random() < 0.4:
                    at = rng.randrange(len(part))
                    part = part[:at] + "X" + part[at + 1 :]
                parts.append(part[rng.randrange(40) :])
            elif kind < 0.7:
                parts.append("z" * rng.randrange(390, 900))
            else:
                parts.append("".join(rng.choice(letters) for _ in range(rng.randrange(500))))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize(("hot", "rows_in_group", "index"), [(16, 2_000, 1_000_000), (2, 2_000, 5_000), (16, 6, 5_000)])
def test_same_as_brute_force(rows, small_batches, monkeypatch, hot, rows_in_group, index):
    monkeypatch.setattr(repeated_bytes, "HOT_CLASSES", hot)
    monkeypatch.setattr(repeated_bytes, "HOT_ROWS", rows_in_group)
    monkeypatch.setattr(repeated_bytes, "INDEX_BYTES", index)
    monkeypatch.setattr(repeated_bytes, "_BLOCK", 700)
    texts = [*passages(3, 50), None, "", "short", "a" * 400, "b" * 399, "c" * 401]
    assert found(repeated_bytes.without_repeats(rows(*texts).repartition(3))) == brute(list(enumerate(texts)))


def test_ids_that_repeat_or_are_missing(rows):
    text = passages(4, 1)[0] + "".join(chr(97 + i * i % 26) for i in range(700))
    own = found(repeated_bytes.without_repeats(rows(text, text, ids=[4, 4])))
    assert own == [brute([(4, text)])[0]] * 2
    pair = found(repeated_bytes.without_repeats(rows(text, text, ids=[None, 4])))
    assert pair == brute([(None, text), (4, text)])
    other = "é" + text
    same_id = found(repeated_bytes.without_repeats(rows(text, other, ids=[7, 7])))
    assert same_id == brute([(7, text), (7, other)])


def test_empty_table(rows):
    assert repeated_bytes.without_repeats(rows(ids=[])).count() == 0


def test_matching_statistics():
    for seed in range(60):
        rng = random.Random(seed)
        pool = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(3)]
        texts = [b"".join(rng.choice(pool) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 6))]
        places = [(i, j) for i, t in enumerate(texts) for j in range(len(t))]

        def shared(x, y):
            a, b = texts[x[0]][x[1] :], texts[y[0]][y[1] :]
            return next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))

        if places:
            want = [max([shared(x, y) for y in places if y != x], default=0) for x in places]
            assert RunLengthIndex(texts).matching_statistics().tolist() == want


def batch(names, rows):
    kinds = [pa.binary() if name == "body" else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def test_crowded_anchors_are_hot_wherever_batches_end():
    crowd = repeated_bytes.HOT_ROWS + 1
    names = repeated_bytes._ROW
    mask = (1 << repeated_bytes._STATE_BITS) - 1
    of = [(a, c, c, c, repeated_bytes.OPEN, 1) for a, n in ((1, crowd), (2, repeated_bytes.HOT_ROWS), (3, 1)) for c in range(n)]
    for cuts in ([], [crowd + 7], [500, 1_600]):
        edges = [0, *cuts, len(of)]
        parts = [batch(names, of[a:b]) for a, b in zip(edges, edges[1:])]
        out = pa.Table.from_batches(list(repeated_bytes._decide(iter(parts))))
        states = Counter((a, p & mask) for a, p in zip(out["anchor"].to_pylist(), out["place"].to_pylist()))
        assert states == {(1, repeated_bytes.HOT): crowd, (2, repeated_bytes.INDEX): repeated_bytes.HOT_ROWS}


def test_parts_of_an_anchor_meet_in_one_index():
    rng = random.Random(3)
    count = 2 * repeated_bytes.HOT_ROWS
    bodies = [rng.randbytes(410) for _ in range(count)]
    bodies[-1] = b"x" + bodies[0][:400] + bodies[-1][:9]
    assert sum(map(len, bodies)) > repeated_bytes.INDEX_BYTES
    of = [(1, 0, 0, d, repeated_bytes.INDEX, 11, b) for d, b in enumerate(bodies)]
    edge = repeated_bytes.HOT_ROWS + 200
    of = of[:edge] + of[edge - 1 :]  # one document is given twice, on both sides of the cut
    parts = [batch([*repeated_bytes._ROW, "body"], p) for p in (of[:edge], of[edge:])]
    out = pa.Table.from_batches(list(repeated_bytes._match(iter(parts))))
    found = sorted(zip(out["doc"].to_pylist(), (np.array(out["place"]) >> repeated_bytes._STATE_BITS).tolist(), out["count"].to_pylist()))
    assert found == [(0, 0, 1), (count - 1, 1, 1)]
