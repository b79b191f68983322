from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from headroom.llm import catalog, quality_classifier, quality_rules
from headroom.llm.common import table


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\n", "a", "a b c", "a b c a b c", "x x x", "x x x x", "é # é # é # é", "l\nl\n l\nl ", "q\x0bq q\x0cq"]
    for _ in range(60):
        vocabulary = rng.choice([["a", "b", "#", "é|"], [str(i) for i in range(60)]])
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(120))))
    return out


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_are_exact(rows):
    found = quality_rules.with_counts(rows(*texts())).select("doc_id", *NAMES).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {i: counts(t) for i, t in enumerate(texts())}


def test_the_slower_way_gives_the_same(rows, monkeypatch):
    monkeypatch.setattr(quality_rules, "LOW_BITS", 3)
    found = quality_rules.with_counts(rows(*texts())).select("doc_id", "n_repeat_words").collect()
    assert {r.doc_id: r.n_repeat_words for r in found} == {i: counts(t)[4] for i, t in enumerate(texts())}


def test_mixed_upper_bits_are_sorted_out(rows, monkeypatch):
    monkeypatch.setattr(quality_rules, "LOW_BITS", 58)
    found = quality_rules.with_counts(rows(*texts())).select("doc_id", "n_repeat_words").collect()
    assert {r.doc_id: r.n_repeat_words for r in found} == {i: counts(t)[4] for i, t in enumerate(texts())}


def test_verdicts(spark, sf_dir, rows):
    judged = catalog.op9_quality_rules(spark, sf_dir)
    assert judged.where(F.col("base_failed") & F.col("kept")).count() == 0
    both = judged.join(table(spark, sf_dir, "labels"), "doc_id").where(~F.col("base_failed"))
    wrong = both.where(F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong <= 0.05 * both.count()
    assert quality_rules.judge(rows(ids=[])).count() == 0
    verdict = quality_rules.judge(rows(None, "", None, ids=[None, 1, 1])).collect()
    assert [r.kept for r in verdict] == [False] * 3
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_classifier_separates_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    scored = catalog.op1_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    rows = scored.select("score", "quality", "predicted").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.97 and sum(r.predicted for r in rows if r.quality == 1) >= 0.97 * len(good)


def test_classifier_without_labels_ids_or_texts(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = rows("a b", None, "", ids=[1, None, 1])
    weights = quality_classifier.fit(docs, none)
    assert [r.score for r in quality_classifier.with_score(docs, weights).collect()] == [0.5] * 3
    split = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    assert not quality_classifier.fit(docs, split).any()
    assert quality_classifier.with_score(rows(ids=[]), weights).count() == 0


def test_held_out_labels_are_not_learned(spark, rows):
    texts = [f"good words here number {i}" if i % 2 else f"bad ### {i}" for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = rows(*texts)
    assert (quality_classifier.fit(docs, labels) == quality_classifier.fit(docs, turned)).all()


def plain_posteriors(votes):
    """Expectation-maximisation over single documents, without Spark: the chance that each is good."""
    names, defects = list(quality_rules.rules()), set(quality_rules.DEFECTS)
    good = [0.1 if any(vote[n] == -1 for n in defects) else 0.9 for vote in votes]
    for _ in range(quality_rules.ROUNDS + 1):
        total = {"good": sum(good), "bad": len(good) - sum(good)}

        def rate(side, name, value):
            hits = sum(g if side == "good" else 1 - g for g, vote in zip(good, votes) if vote[name] == value)
            return (hits + 1) / (total[side] + 3)

        gain = {}
        for n in names:
            on_good, on_bad = rate("good", n, -1), rate("bad", n, -1)
            on_good, on_bad = (min(on_good, 0.002), max(on_bad, 0.05)) if n in defects else (on_good, max(on_good, on_bad))
            silent = math.log((1 - on_good) / (1 - on_bad))
            praise = math.log(rate("good", n, 1) / rate("bad", n, 1))
            gain[n] = {-1: math.log(on_good / on_bad), 0: silent, 1: silent + min(max(praise, 0), 0.5)}
        prior = math.log((total["good"] + 1) / (total["bad"] + 1))
        good = [1 / (1 + math.exp(-prior - sum(gain[n][vote[n]] for n in names))) for vote in votes]
    return good


def test_posteriors_equal_a_plain_version_and_beat_all_must_pass(spark):
    sf_dir = "/root/testdata/sf0.01"
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    found = judged.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").collect()
    votes = [{n: row[f"vote_{n}"] for n in quality_rules.rules()} for row in found]
    for row, chance in zip(found, plain_posteriors(votes)):
        assert abs(row["posterior"] - chance) < 1e-9
        assert row["kept"] == (not row["base_failed"] and chance >= 0.5)
    strict = [min(vote.values()) > -1 for vote in votes]
    assert sum((row["posterior"] >= 0.5) != passed for row, passed in zip(found, strict)) >= len(found) // 100
    known = [(row["posterior"] >= 0.5, passed, row["quality"] == 1) for row, passed in zip(found, strict) if row["quality"] is not None]
    wrong, strictly_wrong = (sum(entry[i] != entry[2] for entry in known) for i in (0, 1))
    assert 2 * wrong <= strictly_wrong
