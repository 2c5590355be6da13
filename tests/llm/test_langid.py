"""Language models against all segmentations written out, and on held-out rows."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import langid, queries
from tests.conftest import SF

PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁▁", "bb"]


@pytest.fixture(scope="module")
def small():
    texts = PIECES + [f"<0x{b:02X}>" for b in range(256)]
    return langid.Vocabulary(texts, list(range(len(texts))), list(range(len(PIECES), len(texts))))


def segmentations(text, words):
    """All ways to cut ``text``, as lists of piece numbers; a character that is no piece is spelled in bytes."""
    if not text:
        yield []
        return
    for i, piece in enumerate(words.texts[: len(PIECES)]):
        if text.startswith(piece):
            for rest in segmentations(text[len(piece) :], words):
                yield [i, *rest]
    if text[0] not in words.texts:
        for rest in segmentations(text[1:], words):
            yield [*words.byte_pieces[list(text[0].encode())].tolist(), *rest]


def plain_likelihood(text, log_probs, words):
    marked = "▁" + text.replace(" ", "▁")
    return [math.log(math.fsum(math.exp(sum(log_probs[i, k] for i in cut)) for cut in segmentations(marked, words))) for k in range(log_probs.shape[1])]


def models(words, k):
    random = np.random.default_rng(5)
    return np.log(random.dirichlet(np.ones(len(words.texts)), k).T)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text("ab \né", max_size=9), min_size=1, max_size=4))
def test_forward_sums_all_segmentations(small, texts):
    log_probs = models(small, 3)
    scorer = langid.Scorer(small, log_probs)
    for _ in range(2):  # the second time from memory
        assert np.allclose(scorer.read(texts), [plain_likelihood(t, log_probs, small) for t in texts])


def test_expected_counts_are_those_of_all_segmentations(small):
    log_probs = models(small, 2)
    units, column, times = [" ab", "abab\n", " b", "éa"], np.array([0, 1, 1, 0]), np.array([3, 1, 2, 5])
    wanted = np.zeros(log_probs.shape)
    for unit, k, n in zip(units, column, times, strict=True):
        cuts = list(segmentations(unit.replace(" ", "▁"), small))
        weights = np.array([math.exp(sum(log_probs[i, k] for i in cut)) for cut in cuts])
        for cut, share in zip(cuts, weights / weights.sum(), strict=True):
            for i, m in Counter(cut).items():
                wanted[i, k] += n * share * m
    assert np.allclose(small.lattice(units).expected(log_probs, column, times), wanted)


def test_very_long_units(small):
    log_probs = models(small, 2)
    text = "ab" * 3000
    whole = langid.Scorer(small, log_probs).read([text])
    assert np.isfinite(whole).all() and (whole < -700).all()  # no underflow


ODD = [
    (1, None, "en"), (2, "", "en"), (3, "1234 !?", "en"), (4, "the and of", "en"), (4, "the and of", "en"), (5, "le la les une", "fr"), (6, "the of", None), (None, "la une", "fr"),
    (7, "日本語のテキスト" * 40, "ja"), (8, "\n \n", "fr"), (9, "the▁of", "en"), (10, "x" * 3000, "en"), (11, "🎉", None),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("unit", F.lit(1))
    model = langid.fit(docs)
    assert model.languages == ["en", "fr", "ja"] and np.allclose(np.exp(model.log_probs).sum(axis=0), 1)
    out = langid.predict(docs, model)
    assert out.columns == ["doc_id", "lang_pred", "score"]
    rows = out.collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert [got[k] for k in (1, 2, 3, 8, 11)] == [("und", 0.0)] * 5
    assert (got[4][0], got[5][0], got[None][0], got[6][0], got[7][0]) == ("en", "fr", "fr", "en", "ja")
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).collect() == []


def test_parts_are_counted_alike_in_any_number_of_flushes(spark, monkeypatch):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").coalesce(1)
    once = sorted(map(tuple, langid.part_counts(docs, "text", "lang").collect()))
    monkeypatch.setattr(langid, "COUNTED", 0)
    assert sorted(map(tuple, langid.part_counts(docs, "text", "lang").collect())) == once


def test_held_out_rows_of_the_whole_table(spark):
    out = queries.op12_language_id(spark, SF)
    assert sorted(out.columns) == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = out.join(docs, "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[0] >= 0.95 and right[1] > 20
