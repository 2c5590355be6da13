"""Token counts by source, language and tokenizer version, maintained by deltas.

A change is a signed count: an insert adds a document and its tokens, a delete
takes them away, a revision is a delete of the old count and an insert of the
new one.  A batch of changes is summed by group (combined before the shuffle,
so a hot source is a handful of rows) and written to a folder of its own, named
by the batch.  A batch whose folder is complete isn't applied again; one that
was cut off is written anew.  Totals are the sum over all complete batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import tokens

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def counted(docs: DataFrame, tokenizer: str = "byte_bpe_50k", path: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, source, lang, tid (digest of the text), tokenizer and n_tokens of every row; null texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.byte_pair(path, ranks)
        for batch in batches:
            counts = [len(encoder.encode(t)) // 4 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "source", "lang", "tid")), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "tid", "n_tokens"])

    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.unhex(F.md5(body)).alias("tid"), body.alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tid binary, n_tokens long").withColumn("tokenizer", F.lit(tokenizer))


def words_counted(docs: DataFrame, tokenizer: str = "words-1") -> DataFrame:
    """As ``counted``, for the tokenizer whose tokens are runs of anything but white space."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.unhex(F.md5(body)).alias("tid"), n.alias("n_tokens"), F.lit(tokenizer).alias("tokenizer"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Inserts (1) or deletes (-1) of these counts."""
    return counts.select(*GROUP, F.lit(sign).cast("long").alias("documents"), (F.col("n_tokens") * sign).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts taken away, the new ones added; they may differ in count, source, language or tokenizer."""
    return signed(old, -1).union(signed(new, 1))


def _folder(store: str, batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"not a batch id: {batch!r}")
    return f"{store.rstrip('/')}/batch={batch}"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def commit(store: str, batch: str, changes: DataFrame) -> bool:
    """Applies a batch once; says whether it did.  The marker of a complete folder is its ``_SUCCESS`` file."""
    spark, folder = changes.sparkSession, _folder(store, batch)
    if _exists(spark, f"{folder}/_SUCCESS"):
        return False
    changes.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0").write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
    return True


def totals(spark: SparkSession, store: str, batches: list[str]) -> DataFrame:
    """Documents and tokens of each group over the named batches that are complete; groups that came to nothing are left out.

    Null sources and languages are groups of their own.
    """
    done = [_folder(store, b) for b in dict.fromkeys(batches) if _exists(spark, f"{_folder(store, b)}/_SUCCESS")]
    deltas = spark.read.schema(DELTA).parquet(*done) if done else spark.createDataFrame([], DELTA)
    summed = deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return summed.where("documents <> 0 or tokens <> 0")


def compact(spark: SparkSession, store: str, batches: list[str], into: str) -> None:
    """Writes the totals of the batches as one batch of their own, to be read in their place."""
    commit(store, into, totals(spark, store, batches))
