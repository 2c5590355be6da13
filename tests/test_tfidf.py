"""TF-IDF over all documents, against a brute-force version."""

import math
import re
from collections import Counter

import pytest

from quillmark.operators import model, tfidf
from quillmark.plans import catalogue

TEXTS = ["The cat sat on the mat, don't", "a cat", "", "no", "x", None, "the cat " * 3000, "a cat", "été à la mer", "abc"]


def brute(texts, terms):
    counts = {i: Counter(terms((t or "").lower())) for i, t in enumerate(texts)}
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for i, c in counts.items():
        w = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        out |= {(i, t): x / length for t, x in w.items()}
    return out


@pytest.mark.parametrize(
    "name, terms",
    [
        ("tfidf_word_documents", lambda t: re.findall(r"\w[\w'®]*\w", t)),
        ("tfidf_char_documents", lambda t: [t[i : i + 3] for i in range(len(t) - 2)]),
    ],
)
def test_tfidf_over_documents(spark, tmp_path, name, terms):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id, r.term): r.weight for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    wanted = brute(TEXTS, terms)
    assert got.keys() == wanted.keys()
    assert all(abs(got[k] - wanted[k]) < 1e-6 for k in wanted)


def test_short_texts_have_no_trigrams(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert all(len(r.term) == 3 for r in catalogue.QUERIES["tfidf_char"](spark, str(tmp_path)).collect())


@pytest.mark.parametrize("head, part", [(0, 2**19), (3, 7), (2**18, 1)])
def test_rare_terms_come_back_to_their_rows(spark, tmp_path, monkeypatch, head, part):
    monkeypatch.setattr(tfidf, "HEAD", head)
    monkeypatch.setattr(tfidf, "PART", part)
    texts = [*TEXTS, "été 😀😀😀 " + "w" * 90, "w" * 90]
    spark.createDataFrame([*enumerate(texts), (None, "the")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, terms in (("tfidf_word_documents", lambda t: re.findall(r"\w[\w'®]*\w", t)), ("tfidf_char_documents", lambda t: [t[i : i + 3] for i in range(len(t) - 2)])):
        got = {(r.id, r.term): r.weight for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
        wanted = {k: w for k, w in brute([*texts, "the"], terms).items() if k[0] < len(texts)}  # a row without a key counts, but isn't told
        assert got.keys() == wanted.keys()
        assert all(abs(got[k] - wanted[k]) < 1e-6 for k in wanted)


def test_only_frequencies_of_terms_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model, "tfidf", None)  # joins every (row, term) by term and by row
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("tfidf_word_documents", "tfidf_char_documents"):
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_rows_that_share_a_key_are_one(spark):
    rows = spark.createDataFrame([(1, "abcd"), (1, "bcda"), (2, "abc")], "id long, text string")
    got = {(r.id, r.term): r.weight for r in tfidf.tfidf_trigrams(rows, "id", rows["text"]).collect()}
    assert len(got) == 4 and got[1, "bcd"] == max(got[1, t] for t in ("abc", "bcd", "cda"))
