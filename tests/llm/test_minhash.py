from __future__ import annotations

import random

import numpy as np
import pytest

from headroom.llm import minhash


def word_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def linked(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


def brute(texts):
    sets, root = [word_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if linked(a, sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def changed(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words)


def family_texts(seed, families=12, most=12):
    rng, texts = random.Random(seed), []
    for _ in range(families):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, most)):
            texts.append(changed(rng, words, rng.choice([0, 0, 0.02, 0.05, 0.1])))
    rng.shuffle(texts)
    return texts


def test_permutation_is_one():
    blocks = [np.arange(i << 20, (i + 1) << 20, dtype=np.uint32) for i in (0, 1, 4095)]
    for block in blocks:
        assert len(np.unique(minhash._permuted(block.copy()))) == len(block)


def test_signature_is_circulant():
    elements = np.random.default_rng(1).integers(0, 2**63, 700).astype(np.uint64)
    scattered = minhash._permuted((elements ^ (elements >> np.uint64(32))).astype(np.uint32)).astype(np.uint64)
    found = minhash.signature(elements, 50)
    for k in (0, 1, 7, 49):
        shifted = ((scattered + np.uint64(2**32 - k)) % np.uint64(2**32)).astype(np.uint32)
        assert found[k] == minhash._permuted(shifted).min()


@pytest.mark.parametrize("size", [2, 8, 40, 3000])
def test_similar_sets_share_a_band(size):
    rng, shares = np.random.default_rng(size), []
    for _ in range(300):
        common = rng.integers(0, 2**63, 4 * size).astype(np.uint64)
        one, other = (np.concatenate([common, rng.integers(0, 2**63, size // 2).astype(np.uint64)]) for _ in range(2))
        one, other = (minhash.bands(s) for s in (one, other))
        shares.append(np.mean(one == other))
    assert min(shares) > 0 and 0.2 < np.mean(shares) < 0.33  # 0.8 to the sixth power is 0.26


def test_equals_brute_force(rows, small_batches):
    texts = family_texts(1) + [None, "", " \n\t", "one", "One", "one two", "é É", "a b c d e", "A B  C\nD E", "a b c d f"]
    found = minhash.near_duplicates(rows(*texts).repartition(3)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == brute(texts)


@pytest.mark.parametrize("block, hub", [(2, 3), (5, 1_000), (512, 4)])
def test_large_buckets_in_blocks(rows, monkeypatch, small_batches, block, hub):
    """Copies that are similar to their original but hardly to each other, so that no single centre finds them all."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "HUB_BUCKET", hub)
    monkeypatch.setattr(minhash, "PER_CENTRE", 4)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(200)]
    texts = [changed(rng, words, rng.choice([0.03, 0.05, 0.06, 0.08])) for _ in range(60)] + [" ".join(words)] + family_texts(2, 4)
    found = minhash.near_duplicates(rows(*texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == brute(texts)


def test_bridges_in_one_bucket(spark, monkeypatch):
    """Nodes that all share a bucket: what connects them is found whatever the centre."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    texts = family_texts(5, 6, 20)
    sets = [minhash.shingles(t) for t in texts]
    data = [(i, len(s), [7], minhash.pack(t.encode()), i) for i, (t, s) in enumerate(zip(texts, sets)) if len(s)]
    nodes = spark.createDataFrame(data, "node long, n_shingles long, bands array<long>, packed binary, row long")
    nodes = nodes.withColumn("node", nodes["node"].cast("decimal(38,0)"))
    root = {r.node: r.root for r in minhash.components(minhash.links(nodes)).collect()}
    # equal sets are one node in the operator, here they are nodes of their own
    assert [root.get(i, i) for i, *_ in data] == [b[2] for b in brute(texts) if b[1]]


def test_in_common_and_spanning(monkeypatch):
    monkeypatch.setattr(minhash, "_CELLS", 40)
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 30))), np.uint64) for _ in range(9)]
    found = minhash.in_common(sets)
    assert all(found[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    assert minhash.spanning(np.eye(4, dtype=bool)) == []
    near = np.zeros((4, 4), bool)
    near[0, 3] = near[3, 0] = near[3, 1] = near[1, 3] = True
    assert sorted(map(sorted, minhash.spanning(near))) == [[0, 3], [1, 3]]


def test_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    data = [(3, "a b c"), (3, "x y z"), (3, "x y z"), (None, "a b c"), (None, "q r s"), (None, "q r s"), (None, None), (4, long), (5, long + " more"), (-1, "A b c")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in data], "doc_id long, text string, node int, `a.b c` string")
    found = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    expected = [(3, 2, -1, False), (3, 2, 3, True), (3, 2, 3, True), (None, 2, -1, False), (None, 2, None, True), (None, 2, None, True), (None, 0, None, True)]
    expected += [(4, 149_999, 4, True), (5, 150_000, 4, False), (-1, 2, -1, True)]
    assert found == sorted(expected, key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []
