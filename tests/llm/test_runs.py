"""Runs against a plain version that tries every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import queries, runs
from tests.conftest import SF


def plain_runs(words, least_length=6, least_exponent=4):
    n = len(words)
    seen = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    found = {}
    for q in range(1, n // least_exponent + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s + q >= max(least_length, least_exponent * q):
                found.setdefault((s, e - s + q), q)  # the smallest period comes first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def digest(doc_id, words):
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    drop = set()
    for s, n, q in found:
        drop.update(range(s + q, s + n))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *(best or (None, None, None)), best[1] * 1000 // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(text))


def test_the_query_on_the_whole_table(spark):
    out = queries.op11_word_runs(spark, SF)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, out.collect())) == sorted(digest(r["doc_id"], planted(r["doc_id"], r["text"])) for r in docs)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 6), st.integers(2, 4))
def test_small_alphabets(words, least_length, least_exponent):
    assert runs.runs_of_words(words, least_length, least_exponent) == plain_runs(words, least_length, least_exponent)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=6))
def test_powers(parts):
    words = [w for root, times in parts for w in root * times]
    assert runs.runs_of_words(words, 2, 2) == plain_runs(words, 2, 2)
    assert runs.runs_of_words(words, 6, 4) == plain_runs(words, 6, 4)


def test_long_texts_of_one_word_and_of_fibonacci():
    assert runs.runs_of_words([0] * 100_000, 6, 4) == [(0, 100_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert runs.runs_of_words(b, 2, 2) == plain_runs(b, 2, 2)
    long = [*range(700)] * 9 + [1, 2, 3]
    assert runs.runs_of_words(long, 6, 4) == plain_runs(long)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (5, "a b " * 9), (None, "x y x y x y x y z"), (6, "one"), (7, "a b c\n" * 200 + "d " * 30)]


def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1))
    words = {(d, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in ODD}
    found = runs.find(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert sorted(map(tuple, runs.digests(found).collect()), key=repr) == sorted((digest(d, words[d, t]) for d, t in ODD), key=repr)
    assert runs.find(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find(docs, least_exponent=1)
