from __future__ import annotations

import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from headroom.llm import catalog, language, packing, personal_data
from headroom.llm.common import table


def test_language_of_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    found = catalog.op6_language_id(spark, sf).where("held_out").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    assert found.where("lang != lang_pred").count() <= 0.02 * found.count()
    assert found.where("score < 0 OR score > 1").count() == 0


def test_texts_without_letters_and_tables_without_labels(rows):
    docs = rows("only words", None, "", "12 .. 34", "ж", ids=[1, None, 3, 3, 5]).withColumn("lang", F.lit(None).cast("string"))
    found = language.with_language(docs, language.fit(docs)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    known = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 5, "ru"))
    model = language.Model(["en"], np.ones((1 << language.BITS, 1), np.float32))
    names = {r.row.doc_id: r.lang_pred for r in language.with_language(known, model).collect()}
    assert names == {1: "en", None: "und", 3: "und", 5: "en"}
    assert language.with_language(rows(ids=[]), model).count() == 0


def test_presence_covers_the_whole_text(monkeypatch):
    text = "abc " * 50 + "xyz"
    whole = language.presence(text)
    monkeypatch.setattr(language, "_BLOCK", 7)
    assert (language.presence(text) == whole).all() and (whole != language.presence("abc " * 50)).any()


@pytest.fixture(scope="module")
def vocabulary():
    return packing.vocabulary_text(catalog.vocabulary_path())


TEXTS = [None, "", " \n", "One sentence. Two!  three?", "DON'T 12 ½ naïve İx ﬁ á ß z", "<|x|> #tag @me a.b,c", "word " * 9000,
         "No end to this " * 400, "Short. " * 700, "x" * 5000]


@pytest.mark.parametrize("block", [packing.BLOCK_TOKENS, 9000])
def test_pieces_give_back_every_id_once(rows, small_batches, vocabulary, monkeypatch, block):
    monkeypatch.setattr(packing, "_SEGMENT", 3000)
    texts = TEXTS + [f"Text number {i}. It has some words, and a few more." * (i % 40) for i in range(200)]
    docs = rows(*texts).repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id")
    pieces = packing.packed(docs, vocabulary, with_ids=True, block_tokens=block).toPandas()
    tokenizer = Tokenizer.from_str(vocabulary)
    for i, text in enumerate(texts):
        own = pieces[pieces.doc_id == i].sort_values("start")
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert [x for ids in own.ids for x in ids] == want
        assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and set(own.doc_tokens) == {len(want)}
    for ids, crc in zip(pieces.ids, pieces.ids_crc32):
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == crc
    padding = total = 0
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        size = own.length.sum()
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and size <= 4096
        padding += 0 if size & (size - 1) == 0 else 4096 - size
        total += size
    assert padding <= 0.05 * total


def test_cuts_cost_as_little_as_trying_all():
    rng = np.random.default_rng(4)
    for _ in range(200):
        places = np.cumsum(rng.integers(1, 9, rng.integers(1, 14)))
        prices = rng.choice([0, 8, 48], len(places))
        length, best = 16, {0: 0}
        for here, price in zip(places, prices):
            options = []
            for before, value in best.items():
                size = here - before
                if 0 < size <= length:
                    options.append(value + price + length - size)
                    if size == length // 2:
                        options.append(value + price + packing.SHORT)
            best[here] = min(options)
        ends = packing.cuts(places, prices, length)
        sizes = np.diff([0, *ends])
        price_of = dict(zip(places, prices))
        cost = sum(price_of[e] + min([length - s] + [packing.SHORT] * int(s == length // 2)) for e, s in zip(ends, sizes))
        assert cost == best[places[-1]] and sizes.max() <= length


def test_repeated_rows_and_empty_table(rows, vocabulary):
    pieces = packing.packed(rows("a b", "a b", None, ids=[1, 1, None]), vocabulary).collect()
    assert sorted(((p.doc_id, p.length) for p in pieces), key=str) == [(1, 3), (1, 3), (None, 1)]
    assert packing.packed(rows(ids=[]), vocabulary).count() == 0


def test_stages_keep_what_they_should(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = docs.limit(1).select(F.lit(10**9).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(odd)
    (_, by_language), (_, near), (_, clean), (_, private), (_, pack) = corpus_pipeline.STAGES
    spoken = by_language(spark, docs, sf_dir)
    assert spoken.columns == docs.columns and spoken.count() == docs.count() - 1
    single = near(spark, spoken, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == sorted(
        r[0] for r in catalog.op10_simhash_neardup(spark, sf_dir).select("component_id").distinct().collect()
    )
    left = clean(spark, single, sf_dir)
    dirty = {r.doc_id for r in catalog.op3_decontamination(spark, sf_dir).where("contaminated").collect()}
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in single.collect()} - dirty and left.columns == docs.columns
    safe = private(spark, left, sf_dir)
    before = {r.doc_id: r.text for r in left.collect()}
    for r in safe.collect():
        spans, text = personal_data.forms(before[r.doc_id]), before[r.doc_id]
        assert r.n_chars == len(r.text) and (bool(spans) or r.text == text)
        assert not any(text[b:e] in r.text for k, b, e in spans if k == 0)
    pieces = pack(spark, safe, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(before)


def test_run_and_registered_queries(spark, sf_dir):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert corpus_pipeline.run(spark, sf_dir).agg(F.sum("length")).first()[0] > 0


def test_ids_of_odd_texts(vocabulary):
    rng = np.random.default_rng(6)
    odd = ["a", "B", "é", "É", "ß", "µ", "ª", "²", "½", "7", "'", "'s", "'RE", "s", "t", ".", "!", "_", "-", "\x1c", "\x00", "\x7f", "\xa0", "\x85", " ",
           "\n", "\t", "Œ", "ł", "ж", "İ", "Σ", "é", "́", "ﬁ", "中", " ", "<|", "<|endoftext|>", "👍🏽", "×", "÷", "\xad"]
    texts = ["".join(rng.choice(odd, rng.integers(0, 14))) for _ in range(5000)]
    tokenizer = Tokenizer.from_str(vocabulary)
    words = packing.Words(vocabulary)
    for text, ids in zip(texts, words.ids(texts)):
        assert [*tokenizer.encode(text, add_special_tokens=False).ids, 2] == ids.tolist(), repr(text)


def test_new_pieces_go_to_the_model_once(vocabulary):
    """The library's patterns are for other texts; a piece that is known is not encoded again."""
    words = packing.Words(vocabulary)
    own, asked = words.tokenizer, []
    model = SimpleNamespace(tokenize=lambda piece: asked.append(piece) or own.model.tokenize(piece))
    words.tokenizer = SimpleNamespace(model=model, encode_batch_fast=lambda texts, **_: pytest.fail(f"encoded as text: {texts}") if texts else [])
    for text in ("Zebras don't pay 7 ÉCUS, don't they", "zebras PAY écus"):
        assert words.ids([text])[0].tolist() == [*own.encode(text, add_special_tokens=False).ids, 2]
    assert len(asked) == len(set(asked)) == 8


def test_ids_when_the_table_of_words_starts_anew(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "_WORDS_KEPT", 5)
    monkeypatch.setattr(packing, "_IDS_TOGETHER", 3)
    tokenizer, words = Tokenizer.from_str(vocabulary), packing.Words(vocabulary)
    for texts in (["one two three", None, "four ж five"], ["\x85", "one six ж", ""], ["seven eight nine ten eleven twelve", "one"], ["\xa0"]):
        found = [ids.tolist() for ids in words.ids(texts)]
        assert found == [[*tokenizer.encode(text or "", add_special_tokens=False).ids, 2] for text in texts]
