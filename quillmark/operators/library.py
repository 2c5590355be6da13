"""The ad library: merging sightings, labels and corrections; and the log of collecting runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a merge keeps count of; all others of the library come from an ad's first arrival.
COUNTED = ("id", "first_seen", "last_seen", "times_seen")
#: What a new classification may change.
ANSWERED = ("category", "confidence", "method", "needs_review")


def summarised(batch: DataFrame) -> DataFrame:
    """One row for each id of a batch (id, seq, ts, ..): first and last by arrival, how often, and the first one's other columns."""
    others = [c for c in batch.columns if c not in ("id", "seq", "ts")]
    first = F.min_by(F.struct(F.col("ts").alias("first_ts"), *others), "seq").alias("first")  # of one row, also if two have one seq
    return batch.groupBy("id").agg(first, F.max_by("ts", "seq").alias("last_ts"), F.count("*").alias("seen")).select("id", "first.first_ts", "last_ts", *[F.col(f"first.{c}").alias(c) for c in others], "seen")


def merge(library: DataFrame, batch: DataFrame) -> DataFrame:
    """The library (id, first_seen, last_seen, times_seen, ..) after a batch (id, seq, ts, ..).

    A known id is counted once for each occurrence and takes the last arrival's
    time, even if that is earlier; its other columns, category and human label
    among them, stay.  An unknown one comes in once with its first arrival's
    columns; those that the batch lacks are null, ``manual_label`` 0.
    """
    new = summarised(batch)
    others = [c for c in library.columns if c not in COUNTED]
    both = library.join(new.withColumnsRenamed({c: f"new_{c}" for c in others}), "id", "full_outer")
    known = F.col("times_seen").isNotNull()

    def other(c: str) -> Column:
        fresh = F.col(f"new_{c}") if c in new.columns else F.lit(0 if c == "manual_label" else None)
        return F.when(known, F.col(c)).otherwise(fresh.cast(library.schema[c].dataType)).alias(c)

    merged = {
        "id": F.col("id"),
        "first_seen": F.coalesce("first_seen", "first_ts").alias("first_seen"),
        "last_seen": F.when(known, F.coalesce("last_ts", "last_seen")).otherwise(F.col("first_ts")).alias("last_seen"),
        "times_seen": F.when(known, F.col("times_seen") + F.coalesce("seen", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("times_seen"),
    }
    return both.select(*[merged[c] if c in merged else other(c) for c in library.columns])


def labelled(library: DataFrame, corrections: DataFrame) -> DataFrame:
    """The library with human labels (id, category, ts) set, the last one for each id; of equal times the greater name.

    A labelled ad has confidence 1, method ``manual``, no review and
    manual_label 1, as far as the library has these columns; earlier labels stay.
    """
    last = corrections.groupBy("id").agg(F.max(F.struct("ts", "category")).alias("last")).select("id", F.col("last.category").alias("label"))
    set_to = {"category": F.col("label"), "confidence": F.lit(1.0), "method": F.lit("manual"), "needs_review": F.lit(0)}
    both = library.join(last, "id", "left")
    old = F.coalesce("manual_label", F.lit(0)) if "manual_label" in library.columns else F.lit(0)
    set_now = {c: F.when(F.col("label").isNotNull(), v).otherwise(F.col(c)) for c, v in set_to.items() if c in library.columns}
    return both.withColumns({**set_now, "manual_label": F.greatest(old, F.col("label").isNotNull().cast("int"))}).drop("label")


def unlabelled(library: DataFrame) -> DataFrame:
    """What a retrained model reads again."""
    return library.where("manual_label = 0").select("id", "title", "description", "advertiser", "domain")


def feedback_rows(library: DataFrame) -> DataFrame:
    """Human labels as training rows."""
    return library.where("manual_label = 1").select("title", "description", "advertiser", "domain", "category")


def reclassified(library: DataFrame, answers: DataFrame) -> DataFrame:
    """The library with new answers (id, category, confidence, method, needs_review) where no person has set a label."""
    new = answers.select("id", *[F.col(c).alias(f"new_{c}") for c in ANSWERED], F.lit(True).alias("answered"))
    open_ = F.col("answered") & (F.col("manual_label") == 0)
    both = library.join(new, "id", "left")
    return both.withColumns({c: F.when(open_, F.col(f"new_{c}").cast(library.schema[c].dataType)).otherwise(F.col(c)) for c in ANSWERED}).select(*library.columns)


def runs_log(events: DataFrame) -> DataFrame:
    """Runs from their events (run, at, found, new, error; found null at the start): started, finished, status and counts.

    A run without an end is running; one that ended with an error or found
    nothing has failed.
    """
    ended = F.col("found").isNotNull() | F.col("error").isNotNull()
    runs = events.groupBy("run").agg(F.min("at").alias("started_at"), F.max(F.when(ended, F.col("at"))).alias("finished_at"), F.coalesce(F.max("found"), F.lit(0)).alias("ads_found"), F.coalesce(F.max("new"), F.lit(0)).alias("new_ads"), F.max("error").alias("log"))
    status = F.when(F.col("finished_at").isNull(), "running").when(F.col("log").isNotNull() | (F.col("ads_found") == 0), "failed").otherwise("success")
    return runs.withColumn("status", status)


def last_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("run")).limit(n)


def due(runs: DataFrame, now: Column, hours: float) -> DataFrame:
    """One row: the last success, the hours since, and whether collecting is due (or never was)."""
    last = runs.agg(F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_success"))
    passed = F.timestamp_diff("SECOND", F.col("last_success"), now) / 3600
    return last.select("last_success", passed.alias("hours"), F.coalesce(passed >= hours, F.lit(True)).alias("due"))


def first_wins(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in columns], F.min(order).alias(order))


def known_else(df: DataFrame, known: DataFrame, key: str, label: str, default) -> DataFrame:
    return df.join(known.groupBy(key).agg(F.max(label).alias("__known")), key, "left").withColumn(label, F.coalesce("__known", default)).drop("__known")
