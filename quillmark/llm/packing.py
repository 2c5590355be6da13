"""Hierarchical multi-length packing of documents into training sequences.

1. Each document is encoded where it lies.  Whole windows are cut off at once;
   what is left goes to the smallest context tier that holds it.
2. The plan is made on the histogram of piece lengths, which has one row for
   each length up to the window and so does not grow with the corpus: pieces of
   the long tier open windows whose gaps are filled with the longest shorter
   pieces that fit; each shorter tier packs what remains into windows that are
   exactly full; the rest fills long windows, longest first.
3. Pieces of one length are interchangeable.  The k-th piece of a length takes
   the k-th place that the plan has for it, so the pieces are matched to places
   by their rank alone.  Ranks are counted in salted groups.
4. Sequences of one tier are dealt in turn to step groups that hold the same
   number of tokens, so that each group mixes long and fragmented sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import tokens
from quillmark.llm.batches import release, small
from quillmark.llm.store import materialize

TIERS = (256, 512, 1024, 2048)
END_ID = 1
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def _cut(batches: Iterator[pa.RecordBatch], window: int, path: str | None, ranks: str | None) -> Iterator[pa.RecordBatch]:
    encoder = tokens.byte_pair(path, ranks)
    end = END_ID.to_bytes(4, "little")
    for batch in small(batches):
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids = memoryview(encoder.encode(text or "") + end)
            n = len(ids) // 4
            for start in range(0, n, window):
                stop = min(n, start + window)
                for column, value in zip(out, (doc_id, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        del batch, out
    encoder.known.clear()  # the worker lives on and serves other stages
    release()


def cut_documents(docs: DataFrame, window: int, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces of at most ``window`` ids, each document's end id included."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _cut(b, window, path, ranks), PIECES)


@dataclass
class Pattern:
    """``repeat`` sequences, each filled with these lengths (by count) for a window."""

    window: int
    lengths: Counter
    repeat: int


def _fill(counts: dict[int, int], first: int, window: int) -> Counter:
    """``first`` and then, again and again, the longest piece that fits."""
    chosen = Counter({first: 1})
    gap = window - first
    while gap:
        length = gap
        while length and counts.get(length, 0) <= chosen[length]:
            length -= 1
        if not length:
            break
        n = min(gap // length, counts[length] - chosen[length])
        chosen[length] += n
        gap -= n * length
    return chosen


def plan(histogram: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[Pattern]:
    """Patterns that place every piece of the histogram exactly once."""
    counts = {k: n for k, n in histogram.items() if n}
    longest = tiers[-1]
    patterns: list[Pattern] = []

    def take(window: int, low: int, exact: bool) -> None:
        for first in range(window, low, -1):
            while counts.get(first, 0):
                chosen = _fill(counts, first, window)
                if exact and sum(k * n for k, n in chosen.items()) < window:
                    break
                repeat = min(counts[k] // n for k, n in chosen.items())
                for k, n in chosen.items():
                    counts[k] -= n * repeat
                patterns.append(Pattern(window, chosen, repeat))

    take(longest, longest // 2, exact=False)
    for window in tiers[-2::-1]:
        take(window, window // 2, exact=True)
    take(longest, 0, exact=False)
    return patterns


def places(patterns: list[Pattern], step_tokens: int) -> list[tuple]:
    """Runs of places: (length, first rank, per sequence, end rank, sequence, offset, window, index in the tier, steps of the tier, first step)."""
    per_tier = Counter()
    for p in patterns:
        per_tier[p.window] += p.repeat
    steps = {w: max(1, -(-n * w // step_tokens)) for w, n in per_tier.items()}
    first_step, at = {}, 0
    for w in sorted(steps):
        first_step[w], at = at, at + steps[w]
    rows, ranks, sequence, index = [], Counter(), 0, Counter()
    for p in patterns:
        offset = 0
        for length in sorted(p.lengths, reverse=True):
            each = p.lengths[length]
            rows.append((length, ranks[length], each, ranks[length] + each * p.repeat, sequence, offset, p.window, index[p.window], steps[p.window], first_step[p.window]))
            ranks[length] += each * p.repeat
            offset += each * length
        sequence += p.repeat
        index[p.window] += p.repeat
    return rows


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = 16 * 2048, salts: int = 64, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence, offset, window and step group.

    Null and empty texts are one piece of the end id alone.  Repeated rows are
    packed as often as they occur.  Texts of any length are cut.  Sequences of a
    shorter tier are exactly full; those of the longest may be padded.  Further
    columns are ignored.  No rows give no rows.

    The driver holds the histogram (a row for each length) and the plan, whose
    size depends on the window alone.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, tiers[-1], path, ranks).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    schema = "length int, first_rank long, each long, end_rank long, sequence long, place_offset long, window int, tier_index long, steps long, first_step long"
    runs = spark.createDataFrame(places(plan(histogram, tiers), step_tokens), schema)
    # at most window * salts rows
    before = F.coalesce(F.expr("sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding)"), F.lit(0))
    offsets = counts.select("length", "salt", before.alias("before"))
    local = F.expr("row_number() over (partition by length, salt order by doc_id, start, ids_crc32, doc_tokens)")
    ranked = pieces.withColumn("local", local).join(F.broadcast(offsets), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    placed = ranked.join(F.broadcast(runs.withColumnRenamed("length", "run_length")), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    nth = F.expr("(rank - first_rank) div each")
    return placed.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + nth).alias("sequence_id"),
        (F.col("place_offset") + (F.col("rank") - F.col("first_rank")) % F.col("each") * F.col("length")).cast("long").alias("offset"),
        "window",
        (F.col("first_step") + (F.col("tier_index") + nth) % F.col("steps")).alias("step_group"),
    )
