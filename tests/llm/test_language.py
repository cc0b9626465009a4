"""Language by cross-parsing against plain substring search and held-out labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalsift.llm import language as L


def phrases_of(learned: bytes, text: bytes) -> int:
    """Greedy longest matches by substring search; a byte never learned is a phrase."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in learned:
            size += 1
        at += size
        count += 1
    return count


def test_automaton_holds_every_substring_and_no_more():
    random = np.random.default_rng(1)
    text = bytes(random.integers(97, 100, 60).astype(np.uint8))
    automaton = L.Automaton(text)
    edges = {(int(s), int(c)): int(t) for s, c, t in zip(automaton.source, automaton.symbol, automaton.target)}
    for _ in range(3000):
        word = bytes(random.integers(97, 100, random.integers(1, 9)).astype(np.uint8))
        state = 0
        for c in word:
            state = edges.get((state, c))
            if state is None:
                break
        assert (state is not None) == (word in text)
    assert automaton.states <= 2 * len(text)


def test_phrases_are_greedy_longest_matches():
    random = np.random.default_rng(2)
    learned = [bytes(random.integers(97, 97 + k, 400).astype(np.uint8)) for k in (2, 4)]
    model = L.Model(["a", "b"], [L.Automaton(t) for t in learned])
    texts = [bytes(random.integers(97, 103, random.integers(0, 300)).astype(np.uint8)) for _ in range(60)] + [b"", b"f", b"ab" * 100]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    costs = model.costs(data, offsets)
    for i, text in enumerate(texts):
        for k, known in enumerate(learned):
            want = phrases_of(known, text) * np.log2(400) / max(1, len(text))
            assert costs[i, k] == pytest.approx(want)


def test_long_texts_are_read_whole():
    text = b"abcabc" * 1000 + b"zz"
    model = L.Model(["a"], [L.Automaton(b"xabcabcx")])
    costs = model.costs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    want = sum(phrases_of(b"xabcabcx", text[i : i + L.STRETCH]) for i in range(0, len(text), L.STRETCH))
    assert costs[0, 0] == pytest.approx(want * np.log2(8) / len(text))


def test_letters():
    got = L.letters(pa.array(["Ab, c1d!", "", "12", "ÉÀ 日本", None])).to_pylist()
    assert got[:4] == [" ab c d ", "  ", "  ", " éà 日本 "] and got[4] is None


SHAPE = "doc_id long, text string, lang string, kept_x int, score string"
KNOWN = [(i, t, l, i, "old") for i, (t, l) in enumerate([("the cat and the dog are there", "en"), ("der hund und die katze sind da", "de"), ("日本語 の 文章", "ja")] * 5)]


def test_odd_rows(spark):
    model = L.fitted(spark.createDataFrame(KNOWN + [(99, None, "xx", 1, ""), (None, "12 34", "yy", 1, ""), (98, "abc", None, 1, "")], SHAPE))
    assert model.langs == ["de", "en", "ja"]
    rows = [(1, None, "en", 1, ""), (2, "", None, 1, ""), (3, "42 !?", None, 1, ""), (4, "THE DOG", None, 1, ""), (4, "THE DOG", None, 1, ""), (None, "die Katze", None, 1, ""), (6, "the dog and " * 50_000, None, 1, ""), (7, "日本", None, 1, "")]
    out = L.identified(spark.createDataFrame(rows, SHAPE), model)
    assert out.columns == ["doc_id", "lang", "kept_x", "lang_pred", "score"]
    found = {(r["doc_id"], r["lang_pred"]) for r in out.collect()}
    assert out.count() == 8 and all(0 <= r["score"] <= 1 for r in out.collect())
    assert found == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (6, "en"), (7, "ja")}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SHAPE)
    model = L.fitted(empty)
    assert model.langs == [] and L.identified(empty, model).count() == 0
    rows = L.identified(spark.createDataFrame(KNOWN, SHAPE), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_training_does_not_depend_on_the_order_of_rows(spark):
    df = spark.createDataFrame(KNOWN, SHAPE)
    one, two = L.fitted(df.repartition(3)), L.fitted(df.orderBy(F.desc("doc_id")).coalesce(1))
    assert one.langs == two.langs and all((a.target == b.target).all() for a, b in zip(one.automata, two.automata))


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = L.op12_language_id(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()
    seen = out.where("held_out").join(docs.where("lang is not null"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert seen >= 0.98
