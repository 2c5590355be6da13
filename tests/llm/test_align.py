"""Alignment against a plain version: tokenizers' own encoders on whole texts, every pair of tokens compared."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import align
from tests.conftest import SF

ODD = [
    (1, None), (2, ""), (3, " "), (4, "the cat sat on the mat"), (5, "the cat sat on the mat"), (6, "  two  spaces \n and\tbreaks \n"), (7, "ﬁne ▁ mark"), (8, "<|endoftext|> <s> <0x0A> </s>"),
    (9, "naïve Überraschung 日本語のテキスト 🎉🎉"), (None, "no id"), (10, "x" * 5000), (11, "don't we'll 12345 ..."), (12, " hard space\u0085"), (13, "\0zero \0"), (14, " lead and trail "), (14, "é combining"),
]


def gpt_bytes() -> dict[str, int]:
    """The usual printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), gpt_bytes()


def plain(rows, encoders):
    a, b, letters = encoders
    aligned, counts = [], Counter()
    for doc_id, text in rows:
        if not text:
            aligned.append((doc_id, None))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            aligned.append((doc_id, None))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, j = [], 0
        for i, end in enumerate(ends_a):
            begin = ends_a[i - 1] if i else 0
            while j and ends_b[j - 1] > begin:
                j -= 1
            while ends_b[j] <= begin:
                j += 1
            k = j
            while k < len(ends_b) and (ends_b[k - 1] if k else 0) < end:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        counts.update(links)
        shared = sorted(set(ends_a) & set(ends_b))
        groups, x, y = [], 0, 0
        for e in shared:
            i, k = ends_a.index(e, x) + 1, ends_b.index(e, y) + 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:k])))
            x, y = i, k
        aligned.append((doc_id, (len(ids_a), len(ids_b), groups, links)))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for doc_id, x in aligned:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [align.HOT_PAIRS, 20, 1])
def test_odd_texts_with_pairs_looked_up_or_joined(spark, encoders, hot):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_a", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)
    assert got(align.digests(docs, hot_pairs=hot)) == plain(ODD, encoders)


def test_whole_table_of_documents(spark, encoders):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(align.digests(docs, hot_pairs=500)) == plain(rows, encoders)


def test_a_full_memory_starts_anew(spark, encoders, monkeypatch):
    monkeypatch.setattr(align, "MEMORY_BYTES", 0)
    known = align.Aligner(align.tokenizers(), True)
    for _ in range(2):
        assert known.read(["one two", "two three"])[1] is not None
        assert known.full()
        known.forget()


def test_no_rows(spark):
    assert got(align.digests(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_links_groups_and_products(spark):
    docs = spark.createDataFrame([(1, "Überraschung naïve"), (2, None)], "doc_id long, text string")
    out = align.align(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    one = rows[1]
    assert rows[2]["a_ids"] == [] and sum(one["group_a"]) == len(one["a_ids"]) and sum(one["group_b"]) == len(one["b_ids"])
    products = align.group_products(out).collect()
    assert len(products) == sum(x * y for x, y in zip(one["group_a"], one["group_b"], strict=True))
    linked = {(one["a_ids"][i], one["b_ids"][j]) for i, j in zip(one["link_a"], one["link_b"], strict=True)}
    assert len(one["link_a"]) == len(one["a_ids"]) + len(one["b_ids"]) - len(one["group_a"])
    assert linked <= {(r["a_id"], r["b_id"]) for r in products}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=12))
def test_intervals_are_the_overlaps(a, b):
    a[-1] += max(0, sum(b) - sum(a))
    b[-1] += max(0, sum(a) - sum(b))
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    found = align.overlaps(a_ends, b_ends)
    expected = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(a_ends[i] - a[i], b_ends[j] - b[j]) < min(a_ends[i], b_ends[j])]
    assert list(zip(found.a.tolist(), found.b.tolist(), strict=True)) == expected
