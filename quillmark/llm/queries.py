"""The registered queries of this subpackage and their oracle SQL.

Each query applies its operator, with production parameters, to the whole of
its table; the columns are digests of the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import align, imatch, langid, lines, neardup, oracles, packing, pieces, pivots, rollups, runs, sharding, toxicity, warc
from quillmark.llm.store import fresh_path, materialize, table


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"))).drop("warc_headers", "source_headers")


def op1_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op2_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op5_pivot_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op8_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_removed", F.length("clean_text").cast("long").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four commits: all documents come in; later copies of a text go; what isn't English moves to another tokenizer; the first again, in vain."""
    docs = table(spark, sf_dir, "documents")
    store = fresh_path(spark, "rollups")
    counts = materialize(rollups.counted(docs), "counts")
    rollups.commit(store, "load", rollups.signed(counts, 1))
    first = counts.groupBy("tid").agg(F.min("doc_id").alias("first_id"))
    copies = counts.join(first, "tid").where("doc_id <> first_id")
    rollups.commit(store, "copies", rollups.signed(copies, -1))
    kept = counts.join(first, "tid").where("doc_id = first_id")
    words = rollups.words_counted(docs).join(first, "tid").where("doc_id = first_id and lang <> 'en'")
    rollups.commit(store, "tokenizer", rollups.revised(kept.where("lang <> 'en'"), words))
    rollups.commit(store, "load", rollups.signed(counts, 1))
    return rollups.totals(spark, store, ["load", "copies", "tokenizer"])


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.digests(runs.find(docs.select("doc_id", runs.with_cycles(F.col("text"), F.col("doc_id")).alias("text"))))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).withColumn("held_out", held_out)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op1_warc_records": op1_warc_records,
    "op2_minhash_tensored": op2_minhash_tensored,
    "op3_imatch": op3_imatch,
    "op4_toxicity_mil": op4_toxicity_mil,
    "op5_pivot_top10": op5_pivot_top10,
    "op6_streaming_viterbi": op6_streaming_viterbi,
    "op7_hash_tree_shards": op7_hash_tree_shards,
    "op8_tier_packing": op8_tier_packing,
    "op9_line_chunks": op9_line_chunks,
    "op10_token_rollups": op10_token_rollups,
    "op11_word_runs": op11_word_runs,
    "op12_language_id": op12_language_id,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op1_warc_derivatives": oracles.OP1,
    "op1_warc_records": oracles.OP1_RECORDS,
    "op2_minhash_tensored": oracles.OP2,
    "op3_imatch": oracles.OP3,
    "op5_pivot_top10": oracles.OP5,
    "op7_hash_tree_shards": oracles.op7(),
}
