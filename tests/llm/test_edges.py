"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import imatch, lines, neardup, packing, pieces, pivots, rollups, sharding, toxicity, warc
from quillmark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, component string, n long"
WORDS = " ".join(f"w{i}" for i in range(60))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "c", 1) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (None, WORDS), (7, WORDS), (8, WORDS + " tail"), (9, "x" * 50_000)]


def test_near_duplicates(spark):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, ODD)).collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True)
    assert got[(4, 1)] == (4, True) and got[(5, 1)] == (4, False)
    assert got[(7, 56)] == (7, True) and got[(8, 57)] == (7, False) and got[(None, 56)] == (7, False)
    assert got[(9, 1)] == (9, True)
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert neardup.near_duplicates(docs(spark, ODD)).count() == len(ODD)


def test_keep_one(spark):
    kept = neardup.keep_one(docs(spark, ODD))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 9] and kept.columns == docs(spark, []).columns


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}


def test_sharding(spark):
    got = sharding.shard_rows(docs(spark, ODD), chunks=4).collect()
    assert len(got) == len(ODD) and all(r.grown_shard in (r.shard, 16) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert sharding.shard_rows(docs(spark, [])).count() == 0
    weighted = sharding.HashTree(4, 2, 1, {0: 3.0})
    n = spark.range(4000).select(sharding.place(F.col("id").cast("string"), weighted).alias("s")).groupBy("s").count().collect()
    assert {r.s: round(r["count"] / 4000, 1) for r in n}[0] == 0.5


def test_packing(spark):
    got = packing.pack(docs(spark, ODD), tiers=(8, 16, 32)).toPandas()
    assert len(got[got.doc_id == 1]) == 1 and got[got.doc_id == 1].length.tolist() == [1]
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= seq.window.iloc[0]
    nine = got[got.doc_id == 9].sort_values("start")
    assert nine.length.sum() == nine.doc_tokens.iloc[0]
    assert packing.pack(docs(spark, [])).count() == 0


def test_plan_places_every_piece():
    histogram = {k: (k * 7) % 11 for k in range(1, 33)}
    placed = {}
    for p in packing.plan(histogram, (8, 16, 32)):
        assert sum(k * n for k, n in p.lengths.items()) <= p.window and (p.window == 32 or sum(k * n for k, n in p.lengths.items()) == p.window)
        for k, n in p.lengths.items():
            placed[k] = placed.get(k, 0) + n * p.repeat
    assert placed == {k: n for k, n in histogram.items() if n}


def test_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillmark.llm import tokens

    whole, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.byte_pair()
    for t in ["", " ", "  a", "a  b", "a \n b", "a\n b \nc", "\ta b", "x y ", "it 's we'll", "日本 é", "a b", "<|endoftext|> a", "a\0 b", "a b\n", "a" * 5000 + " b"]:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def brute_viterbi(model, chars):
    best, back = [0] + [None] * len(chars), [None] * (len(chars) + 1)
    for end in range(1, len(chars) + 1):
        for start in range(max(0, end - model.longest), end):
            node = model.trie
            for c in chars[start:end]:
                node = node.get(c) if node is not None else None
            if node and "" in node and (best[end] is None or best[start] + node[""][1] > best[end]):
                best[end], back[end] = best[start] + node[""][1], (start, [node[""][0]])
        spelled = [model.byte_ids[b] for b in chars[end - 1].encode()]
        if best[end] is None or best[end - 1] + model.byte_score * len(spelled) > best[end]:
            best[end], back[end] = best[end - 1] + model.byte_score * len(spelled), (end - 1, spelled)
    out, end = [], len(chars)
    while end:
        end, ids = back[end]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


@pytest.mark.parametrize("text", ["", "a", " a  b ", "日本語 x", "x" * 200, "\n\n a", "the quick brown fox " * 20])
def test_streaming_viterbi(text):
    model = pieces.pieces()
    marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    ids = np.frombuffer(model.encode(text), "<u4").tolist()
    assert ids == brute_viterbi(model, marked) == [i for run in model.stream(marked) for i in run]
    assert model.decode(ids) == text


def test_streaming_viterbi_commits_early():
    model = pieces.pieces()
    runs = model.stream(pieces.MARK.join(["", *["word"] * 50]))
    assert len(list(runs)) > 3


def test_pieces_rows(spark):
    got = pieces.encode(docs(spark, ODD))
    assert got.count() == len(ODD) and got.where("not round_trip").count() == 0
    assert {r.doc_id: r.text for r in pieces.decode(got).collect()}[4] == "one two"


def test_line_chunks(spark):
    passage = "Here begins a passage of many words that stands in two documents alike. It has several sentences, each of them long enough. And then it ends, as every passage must do sooner or later in the day."
    rows = [(1, f"own start\n{passage}\nend one"), (2, f"another\n{passage}\nend two"), (3, "All rights reserved."), (4, "All rights reserved."), (5, None), (6, "")]
    got = {r.doc_id: (r.clean_text, r.n_removed) for r in lines.without_repeats(docs(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[3] == got[4] == ("All rights reserved.", 0)
    assert got[2][0] == "another\nend two" and got[5] == (None, 0) and got[6] == ("", 0)
    assert lines.dedup(docs(spark, ODD)).columns == docs(spark, []).columns
    joined = docs(spark, rows + ODD[-1:]).where("text is not null").select("text", F.array_join(lines.chunks(F.col("text")), "").alias("j"))
    assert joined.where("text <> j").count() == 0
    assert lines.without_repeats(docs(spark, [])).count() == 0


def test_imatch(spark):
    got = {(r.doc_id, r.n_chars): r for r in imatch.edited_fingerprints(docs(spark, ODD)).collect()}
    assert got[(1, 0)].fingerprint == got[(2, 0)].fingerprint and got[(1, 0)].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert imatch.edited_fingerprints(docs(spark, ODD)).count() == len(ODD)
    assert imatch.edited_fingerprints(docs(spark, [])).count() == 0
    # a lexicon too large for one value is joined instead, with the same results
    joined = imatch.edited_fingerprints(docs(spark, ODD), imatch.Band(broadcast_terms=-1))
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, imatch.edited_fingerprints(docs(spark, ODD)).collect()))


def test_pivots_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = np.vstack([rng.normal(size=(300, 8)), np.tile(rng.normal(size=(1, 8)), (50, 1))]).astype("float32")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8), (None, [0.0] * 8), (1003, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in pivots.top_k(df, F.col("vec_id") % 20 == 0, block_rows=64, query_rows=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(1024 * vectors.astype("float64")).astype("int64")
    for q in range(0, 350, 20):
        scores = whole @ whole[q]
        best = sorted((i for i in range(350) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert sorted(got[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(best)]
    assert pivots.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_toxicity(spark):
    rows = [(i, f"some words here number{i}. " + ("you are vile. " if i % 3 == 0 else "") + "the end.") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    got = toxicity.score(docs(spark, rows + ODD), model).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got if r.text and "number" in r.text)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {r.score for r in got if not r.text} == {0.0}
    found = toxicity.offending_sentences(docs(spark, rows), model).collect()
    assert {r.sentence.strip() for r in found} == {"you are vile."}
    assert toxicity.score(docs(spark, []), toxicity.fit(docs(spark, []), labels)).count() == 0


def test_rollups(spark, tmp_path):
    store = "file://" + str(tmp_path)
    counts = rollups.counted(docs(spark, ODD))
    assert rollups.commit(store, "b1", rollups.signed(counts, 1)) and not rollups.commit(store, "b1", rollups.signed(counts, 1))
    assert rollups.commit(store, "b2", rollups.signed(counts.where("doc_id = 9"), -1))
    got = rollups.totals(spark, store, ["b1", "b2", "b3"]).first()
    kept = [r.n_tokens for r in counts.collect() if r.doc_id != 9]
    assert (got.documents, got.tokens) == (len(kept), sum(kept))
    rollups.compact(spark, store, ["b1", "b2"], "c1")
    assert rollups.totals(spark, store, ["c1"]).first().tokens == sum(kept)
    with pytest.raises(ValueError):
        rollups.commit(store, "../x", rollups.signed(counts, 1))


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><head><title>T</title></head><body><p>Hi&amp;lt; <b>you</b></p></body></html>"), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type): r for r in warc.derive(warc.responses(pages)).collect()}
    assert len(got) == 6 and got[(1, "conversion")].block == "Hi&lt; you"
    assert got[(2, "conversion")].block == "" and got[(2, "conversion")].block_digest == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert got[(1, "metadata")].refers_to == got[(1, "conversion")].refers_to != got[(1, "conversion")].record_id
