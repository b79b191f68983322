from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from headroom.llm import simhash
from headroom.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints):
    """Least index reachable over links, by brute force."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if bin(a ^ b).count("1") <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components(rows, small_batches):
    texts = ["The Cat sat on the mat today", "the cat SAT on the mat today", "a b", "A  B", None, "", " \n", "É x", "é x", "one two three " * 30]
    texts += ["one two three " * 30 + "four"]
    found = {r.doc_id: r for r in simhash.near_duplicates(rows(*texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    assert [found[i].fingerprint % 2**64 for i in range(len(texts))] == prints
    assert [found[i].component_id for i in range(len(texts))] == roots(prints)


@pytest.mark.parametrize("most", [3, 2_000])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, most):
    rng = random.Random(most)
    prints = []
    for _ in range(12):
        near = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            prints.append(near)
            for _ in range(rng.randrange(5)):
                near ^= 1 << rng.randrange(64)
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    linked = components(simhash.links(df, most))
    root = {r.node: r.root for r in linked.collect()}
    groups = {}
    for p in signed:
        groups.setdefault(root.get(p, p), set()).add(p)
    want = {}
    for p, r in zip(signed, roots(prints)):
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_paths_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(8, 7), (500, 500)]
    root = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert root == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(8, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives(rows):
    text, other = "some words that repeat here", "entirely different words over there"
    kept = simhash.representatives(rows(text, text, other, other, "third one of its own kind", ids=[4, 2, None, 9, None]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(2, text), (9, other), (None, "third one of its own kind")]
    twice = simhash.representatives(rows(text, text, None, ids=[1, 1, 5]))
    assert sorted(r.doc_id for r in twice.collect()) == [1, 5]
    assert simhash.near_duplicates(rows(ids=[])).count() == 0


def test_each_group_keeps_one_row_where_ids_repeat(rows):
    shared, clean = "some words that repeat here", "entirely different words over there"
    one, two = "the first text of an id", "and another that is nothing like it"
    docs = rows(shared, shared, clean, one, two, "Same Print Here", "same print here", ids=[3, 9, 9, 7, 7, 5, 5])
    kept = [sorted((r.doc_id, r.text) for r in simhash.representatives(docs.orderBy(order)).collect()) for order in ("text", docs.text.desc())]
    assert kept[0] == kept[1]
    assert [k for k in kept[0] if k[0] != 5] == [(3, shared), (7, two), (7, one), (9, clean)]
    assert sum(k[0] == 5 for k in kept[0]) == 1
