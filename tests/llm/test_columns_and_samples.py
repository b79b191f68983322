"""Columns of any name pass through; samples of fits are bounded, whole and the same on every layout."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from headroom.llm import decontaminate, language, minhash, packing, personal_data, quality_classifier, quality_rules, repeated_bytes, repeated_passages, simhash
from headroom.llm.common import is_held_out

ODD = {"my-col": 1, "a.b": "dots", "with blank": [1, 2], "row": "clash", "score": 0.5, "text2": None}


@pytest.fixture
def odd(spark):
    data = [(i, t, "en", *ODD.values()) for i, t in enumerate(["Call me at a@b.com now please", "other words entirely 1 2 3", None, ""] * 4)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, `my-col` int, `a.b` string, `with blank` array<int>, row string, score double, text2 string")


def test_odd_columns_pass_through(odd, spark):
    model = language.Model(["en"], np.ones((1 << language.BITS, 1), np.float32))
    items = spark.createDataFrame([("q1", "words entirely 1 2 3")], "item_id string, text string")
    weights = np.zeros(1 << quality_classifier.BITS, np.float32)
    tables = [
        quality_classifier.with_score(odd, weights).select("row.*"),
        language.with_language(odd, model).select("row.*"),
        decontaminate.clean(odd, items),
        personal_data.redacted(odd),
        simhash.representatives(odd),
    ]
    for found in tables:
        assert found.columns == odd.columns and [f.dataType for f in found.schema] == [f.dataType for f in odd.schema]
        for row in found.collect():
            assert (row["my-col"], row["a.b"], row["with blank"], row["row"]) == (1, "dots", [1, 2], "clash")
    for operator in (minhash.near_duplicates, simhash.near_duplicates, quality_rules.judge, repeated_bytes.without_repeats, repeated_passages.without_repeats):
        assert operator(odd).count() == 16


def labelled(spark, parts, count=400):
    docs = spark.range(count).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good clean words here").otherwise("## bad $$ junk ||").alias("text"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    return docs.repartition(parts), docs.select("doc_id", (1 - F.col("doc_id") % 2).alias("quality"))


def test_classifier_sample_is_by_hash(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda rows, epochs=3: seen.append(rows) or np.zeros(1 << quality_classifier.BITS, np.float32))
    for parts in (1, 7):
        docs, labels = labelled(spark, parts)
        docs = docs.unionByName(docs.where("doc_id < 9"))  # repeated rows are learned from once
        quality_classifier.fit(docs, labels, most_rows=50)
        quality_classifier.fit(docs, labels, most_rows=50, most_features=100)
    whole, budget, again, _ = seen
    assert len(whole) == 50 and {label for label, _, _ in whole} == {0, 1}
    assert 0 < len(budget) < 50 and sum(len(p) for _, p, _ in budget) <= 100
    assert all((a[1] == b[1]).all() for a, b in zip(whole, budget)) and all((a[1] == b[1]).all() for a, b in zip(whole, again))
    usable = docs.where(~is_held_out(F.col("doc_id"))).count()
    assert usable > 50


def test_no_share_rounds_to_nothing(spark):
    """A bound far below the number of rows still learns, whatever the ratio."""
    docs, labels = labelled(spark, 3, 3000)
    assert np.any(quality_classifier.fit(docs, labels, most_rows=4))
    model = language.fit(docs, per_language=1)
    assert model.languages == ["xx", "yy"]
    names = {r.lang_pred for r in language.with_language(docs.select("doc_id", "text"), model).collect()}
    assert names == {"xx", "yy"}


def test_many_languages_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_TEXTS", 60)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), (F.col("id") % 30).cast("string")).alias("text"), (F.col("id") % 30).cast("string").alias("lang"))
    taken = []
    monkeypatch.setattr(language, "train", lambda rows: taken.append(rows))
    language.fit(docs)
    assert len(taken[0]) == 60 and len({name for name, _ in taken[0]}) == 30


def test_language_stage_without_labels(odd, sf_dir):
    """Nothing to learn from: texts with a letter stay; and no row is dropped for being repeated."""
    import corpus_pipeline

    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.keep_language(odd.sparkSession, unknown, sf_dir)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(16) if i % 4 < 2]
    assert corpus_pipeline.keep_language(odd.sparkSession, unknown.unionByName(unknown), sf_dir).count() == 16
    assert corpus_pipeline.keep_language(odd.sparkSession, odd.limit(0), sf_dir).count() == 0
