from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from headroom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = words(text)
        if item_id is not None and w:
            for p in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[p : p + 10]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for window, own in windows.items():
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p : p + len(window)]) == window:
                    hit |= set(range(p, p + len(window)))
                    ids |= own
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha))
    return sorted(out, key=str)


def found(docs, items, **how):
    df = decontaminate.with_hits(docs, items, **how).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        decontaminate.hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("sha"),
    )
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 150])
def test_same_as_brute_force(spark, rows, small_batches, block_chars):
    rng = random.Random(8)
    alphabet = ["the", "THE", "of", "a1", "É", "é", "w2", "Zz"]
    items = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 16)))) for i in range(25)]
    items += [(3, "a second text of item three " * 3), (None, "the of"), (40, None), (41, "..."), (42, items[5][1])]
    texts = [None, "", "!!! ???", "short"]
    for _ in range(40):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.5 else " ".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    benchmark = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, spans double")
    want = brute(list(enumerate(texts)), items)
    assert found(rows(*texts), benchmark, block_chars=block_chars) == want
    assert sum(r[2] > 0 for r in want) > 10


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(rows("a b c"), none) == brute([(0, "a b c")], [])
    assert found(rows(ids=[]), none) == []


def test_clean_documents_stay_as_they_came(spark, rows):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = rows("x one two three four five six seven eight nine ten y", "one two three", None, ids=[5, 6, None])
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [6, None]
