"""TF-IDF of large tables: terms are counted and weighed where their text lies.

Only two things are shuffled: each part's frequencies of terms, and, where the
terms are too many to be told to every task, the rare ones' occurrences.  The
frequent terms, at most HEAD, are sent to the tasks; what is left is joined by
term and comes back to its row.  No term is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text
from quillmark.operators import model
from quillmark.session import scratch

#: Terms that every task is told, at most; none longer than LONGEST characters.
HEAD, LONGEST = 2**18, 64
#: Terms that are counted together, but for a single row with more.
PART = 2**19

#: Of each (row, term): the row, the number of the term in the last array, and how often it occurs.
Counted = tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]


def _pairs(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, code and how often the pair occurs."""
    keys = row * codes + code
    keys.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first] // max(codes, 1), keys[first] % max(codes, 1), np.diff(np.append(first, len(keys)))


def _sizes(column: pa.Array) -> np.ndarray:
    lengths = pc.utf8_length(column) if pa.types.is_string(column.type) else column.value_lengths()
    return lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(column: pa.Array) -> Counted:
    """Counts of the terms of a column of lists; null terms are none."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), _sizes(column))
    if flat.null_count:
        there = flat.is_valid()
        flat, row = flat.filter(there), row[there.to_numpy(zero_copy_only=False)]
    met = flat.dictionary_encode()
    return *_pairs(row, met.indices.to_numpy().astype(np.int64), len(met.dictionary)), met.dictionary


def _trigrams(column: pa.Array) -> Counted:
    """Counts of the sequences of three characters of a column of texts."""
    row = np.repeat(np.arange(len(column)), _sizes(column))
    chars = np.frombuffer("".join(column.fill_null("").to_pylist()).encode("utf-32-le"), np.uint32)
    if len(chars) < 3:
        return *(np.zeros(0, np.int64) for _ in range(3)), pa.array([], pa.string())
    alphabet = np.flatnonzero(np.bincount(chars))
    number = np.zeros(alphabet[-1] + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    code, n = number[chars], len(alphabet)
    inside = row[2:] == row[:-2]
    grams, row = ((code[:-2] * n + code[1:-1]) * n + code[2:])[inside], row[2:][inside]
    if n**3 * len(column) < 2**62:
        row, grams, times = _pairs(row, grams, n**3)
        found, code = np.unique(grams, return_inverse=True)
    else:
        found, code = np.unique(grams, return_inverse=True)
        row, code, times = _pairs(row, code, len(found))
    spelled = alphabet[np.stack([found // n**2, found // n % n, found % n], axis=1)].astype(np.uint32).tobytes().decode("utf-32-le")
    return row, code, times, pa.array([spelled[i : i + 3] for i in range(0, len(spelled), 3)], pa.string())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of few terms."""
    for batch in batches:
        ends = np.cumsum(_sizes(batch["said"]))
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def tfidf(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """``model.tfidf`` of a column of arrays of terms."""
    return _weighed(df, key, terms, _listed, terms)


def tfidf_trigrams(df: DataFrame, key: str, body: Column) -> DataFrame:
    """``model.tfidf`` of all sequences of three characters of a text."""
    return _weighed(df, key, body, _trigrams, text.trigrams(body))


def _weighed(df: DataFrame, key: str, said: Column, count: Callable[[pa.Array], Counted], terms: Column) -> DataFrame:
    spark = df.sparkSession
    rows = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("most")).first()
    if (rows["most"] or 0) > 1:  # rows that share a key are one: their terms have to meet
        return model.tfidf(df, key, terms)
    n = rows["n"]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            _, code, _, found = count(part["said"])
            yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(np.bincount(code, minlength=len(found)), pa.int64())], ["term", "df"])

    path = scratch(spark, "frequencies")
    df.select(said.alias("said")).mapInArrow(frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).write.parquet(path)
    found = spark.read.schema("term string, df long").parquet(path)
    # frequencies in steps of an eighth of a power of two: a few hundred rows at most
    step = F.when(F.char_length("term") <= LONGEST, F.floor(F.log2(F.col("df").cast("double")) * 8)).otherwise(-1)
    steps = {r["step"]: r["n"] for r in found.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    least, room = max(steps, default=0) + 1, HEAD
    for s in sorted(steps, reverse=True):
        room -= steps[s]
        if room < 0 or s < 0:
            break
        least = s
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    head = found.where(step >= least).select("term", idf.alias("idf")).toArrow().combine_chunks()  # HEAD rows at most
    told = spark.sparkContext.broadcast((_one(head["term"]), _one(head["idf"]).to_numpy()))
    whole = all(s >= least for s in steps)
    kind = df.schema[key].dataType

    def weighed(part: pa.RecordBatch) -> tuple[Counted, np.ndarray, np.ndarray]:
        """What a part has, its raw weights, and which of its terms are frequent."""
        row, code, times, own = counted = count(part["said"])
        names, idf = told.value
        place = pc.index_in(own, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)[code]
        return counted, (1 + np.log(times)) * np.append(idf, 0.0)[place], place >= 0

    asked = df.where(F.col(key).isNotNull())
    if not whole:

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                (row, code, times, own), _, known = weighed(part)
                yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(row[~known])), own.take(pa.array(code[~known])), pa.array(times[~known], pa.int64())], ["key", "term", "tf"])

        schema = T.StructType([T.StructField("key", kind), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
        few = asked.select(F.col(key).alias("key"), said.alias("said")).mapInArrow(rare, schema).join(found.where(~(step >= least)), "term")
        back = few.groupBy("key").agg(F.collect_list(F.struct("term", ((1 + F.log("tf")) * idf).alias("w"))).alias("rare")).withColumnRenamed("key", "__key")
        asked = asked.join(back, F.col(key) == F.col("__key"), "left")
    else:
        asked = asked.withColumn("rare", F.lit(None).cast("array<struct<term:string,w:double>>"))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            (row, code, _, own), raw, known = weighed(part)
            row, raw, names = row[known], raw[known], own.take(pa.array(code[known]))
            if not whole:
                more = part["rare"].flatten()
                row = np.concatenate([row, np.repeat(np.arange(len(part)), _sizes(part["rare"]))])
                raw = np.concatenate([raw, more.field("w").to_numpy(zero_copy_only=False)])
                names = pa.concat_arrays([names, more.field("term")])
            length = np.sqrt(np.bincount(row, raw * raw, len(part)))
            yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(row)), names, pa.array(raw / length[row])], [key, "term", "weight"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
    return asked.select(F.col(key).alias("key"), said.alias("said"), "rare").mapInArrow(weights, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
