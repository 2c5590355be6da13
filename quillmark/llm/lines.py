"""Line dedup by content-defined places of comparison.

A text is read as words, cut at blanks and line breaks.  Of the hashes of all
short word sequences the smallest in each window is an anchor, so anchors move
with the content, lie at most a window apart and need no punctuation: any two
equal passages of ``least_words`` words share one.  Where an anchor occurs more
than once, the windows of ``least_words`` words around it are compared by
128 bits of hashes, together or one by one, and those that occur before,
anywhere in the corpus (by doc_id, then place), are removed.  Windows overlap
word by word, so a passage goes up to its last equal word on both sides; only
short lines that it covers by half or less stay whole.  Blanks and line breaks
between words aren't compared.

Words are hashed with numpy in Arrow batches; everything between texts is
DataFrame joins and partial aggregation.  In DataFrame functions alone the same
windows took more than the allowed time (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import passages
from quillmark.llm.batches import small, values
from quillmark.llm.store import join_facts, materialize

LEAST_WORDS = 25
BLANKS = " \n"
#: Stands for the id of rows without one; they come last.
NAMELESS = 2**63 - 1
WINDOWS = "id long, xk long, start int, stop int, h long, d long, own boolean"


def chunks(text: Column) -> Column:
    """The words of a text in order, each with the blanks after it, the first with those before it; joined, they are the text."""
    before = F.regexp_extract(text, f"^[{BLANKS}]+", 0)
    cut = F.split(F.ltrim(text, F.lit(BLANKS)), f"(?<=[{BLANKS}])(?=[^{BLANKS}])")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(cut, lambda w, i: F.when(i == 0, F.concat(before, w)).otherwise(w)))


def _listed(batches: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """Rows of WINDOWS for rows of (id, xk, text, ..); ``find(rows)`` gives text, start, stop, h, d and own."""
    for batch in small(batches):
        texts = batch["text"].to_pylist()
        for a, b in passages.groups(texts):
            rows = batch.slice(a, b - a)
            text, start, stop, h, d, own = find(texts[a:b], rows)
            keys = [rows[c].take(pa.array(text)) for c in ("id", "xk")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(h), pa.array(d), pa.array(own)], ["id", "xk", "start", "stop", "h", "d", "own"])


def _later(rows: DataFrame, ids_repeat: bool) -> DataFrame:
    """``rows`` of WINDOWS with ``later``, whether they repeat an earlier row of the same h and d, and ``n``, how many rows those have."""
    key = ["h", "d"]
    first = rows.groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    known = join_facts(rows, materialize(first, "kinds"), key, "n", rows.count()).withColumn("later", F.col("own") | (F.col("id") > F.col("first_id")))
    if not ids_repeat:
        return known
    texts = known.where("n > 1 and id = first_id").groupBy(*key).agg(F.min("xk").alias("first_xk"))
    return known.join(texts, key, "left").withColumn("later", F.col("later") | F.coalesce(F.col("xk") > F.col("first_xk"), F.lit(False)))


def repeated_windows(texts: DataFrame, least_words: int = LEAST_WORDS, ids_repeat: bool = True) -> DataFrame:
    """(id, xk, starts, stops): for each row (id, xk, text) the windows that occur before.

    Pass ``ids_repeat`` as false only if no two rows have one id.

    All occurrences of a window have one anchor.  Where an anchor has the same
    words around it each time, all its windows are settled at once; otherwise
    the first of each kind is compared window by window.
    """
    listed = texts.mapInArrow(lambda batches: _listed(batches, lambda texts, _: passages.anchors(texts, least_words)), WINDOWS)
    listed = materialize(listed, "anchors")
    repeated = materialize(listed.groupBy("h").agg(F.count("*").alias("held")).where("held > 1"), "held")
    spans = _later(materialize(join_facts(listed, repeated, ["h"], "held", listed.count()), "repeated"), ids_repeat)
    # an anchor of several kinds of windows: some kind has fewer rows than the anchor
    spans = materialize(spans.where("later or n < held").select("id", "xk", "start", "stop", "later"), "settled")
    open_ = spans.where("not later").groupBy("id", "xk").agg(F.collect_list(F.struct("start", "stop")).alias("near"))
    near = texts.join(open_, ["id", "xk"]).select("id", "xk", "text", "near")
    single = near.mapInArrow(lambda batches: _listed(batches, lambda texts, rows: passages.windows(texts, rows["near"].to_pylist(), least_words)), WINDOWS)
    single = _later(materialize(single, "windows"), ids_repeat)
    gone = spans.where("later").select("id", "xk", "start", "stop").union(single.where("later").select("id", "xk", "start", "stop"))
    return gone.groupBy("id", "xk").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))


def _cleaner(least_words: int):
    @F.arrow_udf("struct<text string, n int>")
    def cleaned(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        rows = zip(values(texts), starts, stops, strict=True)
        out = [None if t is None or not a.is_valid else passages.without(t, a.values.to_numpy(), b.values.to_numpy(), least_words) for t, a, b in rows]
        parts = [pa.array([None if o is None else o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int32()))]
        return pa.StructArray.from_arrays(parts, ["text", "n"], mask=pa.array([o is None for o in out]))

    return cleaned


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``clean_text`` and ``n_removed`` (passages) beside its columns.

    The first occurrence of a passage stays: smallest doc_id, then a hash of
    the row, then place; rows without an id come last.  Rows that are equal
    throughout have one key and are treated alike, as one occurrence.  Null
    texts stay null, empty ones empty.  Columns of ``docs`` named clean_text or
    n_removed are replaced.  No rows give no rows.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.drop("clean_text", "n_removed").withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)), "__xk": F.xxhash64("doc_id", body)})
    texts = keyed.select(F.col("__id").alias("id"), F.col("__xk").alias("xk"), body.alias("text"))
    ids = texts.groupBy("id").agg(F.count("*").alias("n"), F.min("xk").alias("low"), F.max("xk").alias("high"))
    rows = ids.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.bool_or(F.col("low") != F.col("high")), F.lit(False)).alias("ids_repeat")).first()
    if rows["most"] > 1:
        texts = texts.dropDuplicates(["id", "xk"])
    else:  # ids alone tell rows apart
        keyed, texts = keyed.withColumn("__xk", F.lit(0).cast("long")), texts.withColumn("xk", F.lit(0).cast("long"))
    gone = repeated_windows(texts, least_words, rows["ids_repeat"]).withColumnsRenamed({"id": "__gone_id", "xk": "__gone_xk", "starts": "__starts", "stops": "__stops"})
    joined = keyed.join(gone, (F.col("__id") == F.col("__gone_id")) & (F.col("__xk") == F.col("__gone_xk")), "left")
    # texts that stay as they are don't go to Python
    cut = F.when(F.col("__starts").isNotNull(), F.col("text").cast("string"))
    done = joined.withColumn("__done", _cleaner(least_words)(cut, F.col("__starts"), F.col("__stops")))
    return done.withColumns({"clean_text": F.when(F.col("__starts").isNull(), F.col("text")).otherwise(F.col("__done.text")), "n_removed": F.coalesce("__done.n", F.lit(0))}).drop("__id", "__xk", "__gone_id", "__gone_xk", "__starts", "__stops", "__done")


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` (and ``n_chars`` counted anew); documents of which nothing is left go."""
    columns = docs.columns
    done = without_repeats(docs, least_words)
    done = done.where((F.col("n_removed") == 0) | (F.regexp_replace("clean_text", "[ \n]+", "") != ""))
    done = done.withColumn("text", F.col("clean_text"))
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("clean_text")).cast(docs.schema["n_chars"].dataType))
    return done.select(*columns)
