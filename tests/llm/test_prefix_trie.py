from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from headroom.llm import prefix_trie


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ends[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def under(node):
        found, todo = [], [node]
        while todo:
            found.append(todo.pop())
            todo += children[found[-1]]
        return found

    out = set()
    for node, own_members in members.items():
        below = under(node)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ids = ",".join(map(str, sorted(ends[node]))).encode()
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not children[n] for n in below)
        out.add((min(own_members), len(node), parent, len(own_members), len(children[node]), leaves, saved, hashlib.sha256(ids).hexdigest()))
    return out


def trie(spark, data, rows=250_000, parts=4):
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(parts)
    turns, conversations = prefix_trie.rebuilt(prefix_trie.ordered_turns(table, rows))
    found = [tuple(r) for r in prefix_trie.prefix_trie(turns, conversations, rows).collect()]
    assert len(found) == len(set(found))
    return set(found)


def made(seed, conversations=60, longest=14):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(3 * conversations), conversations):
        common = rng.random() < 0.5
        for turn in range(rng.randrange(1, longest)):
            text = f"turn {turn} é" if common and rng.random() < 0.9 else f"own {rng.randrange(4)}"
            rows.append((c, turn, "user" if turn % 2 else "assistant", text))
    return rows


@pytest.mark.parametrize("rows", [250_000, 6])
def test_equals_brute_force(spark, small_batches, rows):
    data = made(rows)
    assert trie(spark, data, rows) == brute(data)


def test_one_long_conversation_and_many_ends_in_one_node(spark, monkeypatch, small_batches):
    monkeypatch.setattr(prefix_trie, "IDS_IN_ROW", 3)
    data = [(1000, i, "user", f"t{i % 7}") for i in range(120)] + [(1001, i, "user", f"t{i % 7}") for i in range(100)]
    data += [(c, i, "user", "same " * 3) for c in range(5, 60) for i in range(9)]  # long enough for any checksum
    assert trie(spark, data, 8) == brute(data)


def test_nulls_ties_repeats_and_blanks(spark):
    data = [(1, None, None, "first"), (1, 0, "user", None), (2, 0, "user", None), (2, 0, "user", None), (None, 0, "user", "lost")]
    data += [(5, 3, "", ""), (5, None, None, None), (6, 1, "a", "x" * 300_000), (7, 1, "a", "x"), (8, -(2**62), "a", "x"), (8, 2**62, "a", "y")]
    data += [(10, 0, "b", "same turn"), (10, 0, "a", "same turn"), (2**62, 0, "b", "far"), (-(2**62) - 2, 0, "b", "far")]
    found, expected = trie(spark, data), brute([row for row in data if row[0] != 10])
    # the order of equal turns is that of their hashes: only the nodes of conversation 10 may differ from the brute force
    assert {row for row in expected if row[1] > 0} <= found
    assert {row[3] for row in found if row[1] == 0} == {9}


def test_turnless_and_empty(spark):
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert trie(spark, [(lone, 0, "user", "gone")]) == brute([(lone, 0, "user", "gone")])
    assert trie(spark, []) == set()
    assert trie(spark, [(None, 0, "user", "x")]) == set()
