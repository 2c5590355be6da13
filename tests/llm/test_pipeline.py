"""The pipeline's stages and run(), on the smallest tables with planted copies, a planted passage and what is toxic there."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import tokens, toxicity
from tests.conftest import SF

COPY, NEAR, PASSAGE = 10**6, 10**6 + 1, 10**6 + 2


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with the smallest documents and three more, and the texts by id."""
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    clean = toxicity.keep_clean(docs, model).where("length(text) between 2000 and 6000").orderBy("doc_id").limit(2).collect()
    source, other = clean
    words = source["text"].split(" ")
    near = " ".join([*words[:5], "zzyx", *words[6:]])
    own = " ".join(f"own{k}" for k in range(300))
    more = [(COPY, other["text"]), (NEAR, near), (PASSAGE, f"{own}\n{' '.join(words[20:100])}\n{own[::-1]}")]
    rows = [source.asDict() | {"doc_id": i, "text": t, "n_chars": len(t)} for i, t in more]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    return folder, texts, source["doc_id"], other["doc_id"]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        assert 0 < after.count() <= docs.count()
        docs = after.persist()


def test_run_on_planted_rows(spark, planted):
    folder, texts, source, other = planted
    packed = corpus_pipeline.run(spark, folder).persist()
    tokens_of = {r["doc_id"]: r["doc_tokens"] for r in packed.select("doc_id", "doc_tokens").distinct().collect()}
    whole = {i: len(tokens.byte_pair().encode(t)) // 4 + 1 for i, t in texts.items()}
    # a copy goes; of a near copy line dedup leaves the few words around the change
    assert COPY not in tokens_of and tokens_of.get(NEAR, 0) < 60 < whole[NEAR]
    assert tokens_of[other] == whole[other] or whole[other] > tokens_of[other] > 0
    assert tokens_of[source] > 0
    # the passage goes, the text around it stays
    apart = len(tokens.byte_pair().encode(texts[PASSAGE].split("\n")[0])) // 4
    assert 2 * apart * 0.9 < tokens_of[PASSAGE] < whole[PASSAGE]
    # what the model calls toxic goes, all else that is no copy stays or lost repeated lines
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "predicted").collect()
    toxic = {r["doc_id"] for r in scored if r["predicted"]}
    assert toxic and toxic.isdisjoint(tokens_of)
    # every id lies in one piece, and pieces fill their sequences without overlap
    sums = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t").count()
    assert sums == 0
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed.collect())
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert o2 == (o + n if s2 == s else 0)
