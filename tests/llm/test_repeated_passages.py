from __future__ import annotations

import hashlib
import random

import pytest

from headroom.llm import repeated_passages


def brute(docs):
    """Every window against every earlier one; ``docs`` is a list of (id, text)."""
    seen, out = set(), []
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    gone = {}
    for i in order:
        words = (docs[i][1] or "").encode().split()
        hit = set()
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                hit |= set(range(p, p + 20))
            seen.add(window)
        gone[i] = hit
    for i, (doc_id, text) in enumerate(docs):
        words = (text or "").encode().split()
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone[i])
        out.append((doc_id, len(words), len(gone[i]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def passages(seed, count, words=400):
    """Texts put together from shared passages, own words, runs of one word and near copies."""
    rng = random.Random(seed)
    pool = [[str(rng.randrange(50)) for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    texts = []
    for _ in range(count):
        words = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.5:
                part = list(rng.choice(pool))
                if rng.random() < 0.3:
                    part[rng.randrange(len(part))] = "edit"
                words += part[rng.randrange(4) :]
            elif kind < 0.7:
                words += ["same"] * rng.randrange(1, 70)
            else:
                words += [str(rng.randrange(10**6)) for _ in range(rng.randrange(30))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    return texts


@pytest.mark.parametrize("hot", [2, 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(rows, small_batches, monkeypatch, seed, hot):
    monkeypatch.setattr(repeated_passages, "HOT", hot)
    texts = [*passages(seed, 60), None, "", " \n", "a b c", "Ünï wörd " * 30, "Ünï wörd " * 30]
    docs = rows(*texts).repartition(3)
    assert found(repeated_passages.without_repeats(docs)) == brute(list(enumerate(texts)))


def test_ids_that_repeat_or_are_missing(rows):
    text, other = " ".join(map(str, range(30))), " ".join(map(str, range(5, 45)))
    got = found(repeated_passages.without_repeats(rows(text, text, text, other, ids=[4, 4, 9, None])))
    assert [(r[0], r[1], r[2]) for r in got] == [(4, 30, 25), (4, 30, 25), (9, 30, 30), (None, 40, 0)]
    two = found(repeated_passages.without_repeats(rows(text, other, ids=[7, 7])))
    assert sorted(r[2] for r in two) in ([0, 25], [0, 25])


def test_empty_table(rows):
    assert repeated_passages.without_repeats(rows(ids=[])).count() == 0
