"""Ads as they are found: each element of a page counts once, ads are merged into the library, and every run is logged.

The stream's rows are elements: one ad at one place of one page at one time.
``dropDuplicatesWithinWatermark`` keeps the elements of the last days in Spark's
state store, dealt out by element, so a replayed file counts nothing, whether in
the same run or after a restart.  What is new goes to the library's buckets, by
batch; each batch has a name there, so one that runs again after a crash between
the library's commit and the stream's changes nothing.
"""

from __future__ import annotations

import datetime
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quillmark.operators import library
from quillmark.sources.store import Change, LibraryStore

RUN_EVENTS = "run string, at timestamp_ntz, found long, new long, error string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_on_disk(spark: SparkSession) -> None:
    """Keeps the state of streams in RocksDB, so that executors hold little of it in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def new_elements(stream: DataFrame, within: str = "7 days") -> DataFrame:
    """Rows (element, id, seq, ts, ..) whose element wasn't seen ``within`` that time; without an element, id and seq stand for it.

    Rows older than the newest by more than that go, since their elements may
    have been forgotten.
    """
    known = F.coalesce("element", F.concat_ws("\0", F.lit(""), "id", F.col("seq").cast("string")))
    return stream.withColumn("element", known).withWatermark("ts", within).dropDuplicatesWithinWatermark(["element"])


class RunLog:
    """What happened to each run, as rows that are only ever added."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, run: str, found: int | None = None, new: int | None = None, error: str | None = None, at: datetime.datetime | None = None) -> None:
        at = at or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(run, at, found, new, error)], RUN_EVENTS).coalesce(1).write.mode("append").parquet(self.folder)

    def runs(self) -> DataFrame:
        """Runs with start, end, status and counts; none before the first."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return library.runs_log(self.spark.read.schema(RUN_EVENTS).parquet(self.folder) if there else self.spark.createDataFrame([], RUN_EVENTS))

    def due(self, now: Column, hours: float) -> bool:
        return library.due(self.runs(), now, hours).first()["due"]


class _Listener(StreamingQueryListener):
    """Adds a row when the named query starts, and one with its counts (found, new) when it ends."""

    def __init__(self, name: str, log: RunLog, counts: Callable[[], tuple[int, int]]):
        self.name, self.log, self.counts = name, log, counts
        self.runs: dict[str, str] = {}
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs[str(event.runId)] = f"{event.timestamp} {event.runId}"
            self.log.add(self.runs[str(event.runId)])

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = self.runs.pop(str(event.runId), None)
        if run:
            self.log.add(run, *self.counts(), event.exception)
            self.ended.set()


@dataclass
class Intake:
    """Takes elements (element, id, seq, ts, an ad's columns, and ``label`` for a person's correction) into a library.

    ``classify`` gives ads that the library doesn't have their category,
    confidence, method and needs_review; without it the stream's own count.  A
    row with a label is no sighting: it sets the category of a known ad and is
    kept by all later sightings and answers.
    """

    store: LibraryStore
    log: RunLog
    checkpoint: str
    name: str = "intake"
    within: str = "7 days"
    classify: Callable[[DataFrame], DataFrame] | None = None
    #: Of each batch, how many sightings counted and what they changed.
    batches: dict[int, tuple[int, Change]] = field(default_factory=dict)

    def _after(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        seen = rows.where("label is null").drop("label")
        if self.classify:
            fresh = self.classify(seen.join(old.select("id"), "id", "left_anti"))
            seen = seen.join(old.select("id"), "id", "left_semi").unionByName(fresh, allowMissingColumns=True)
        corrections = rows.where("label is not null").select("id", F.col("label").alias("category"), F.col("seq").alias("ts"))
        return library.labelled(library.merge(old, seen), corrections).select(*old.columns)

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
        rows = batch.drop("element").withColumn("ts", text).persist()
        try:
            found = rows.where("label is null").count()
            self.batches[batch_id] = (found, self.store.change(rows, self._after, f"{self.name}:{batch_id}"))
        finally:
            rows.unpersist()

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        """Starts taking in; without ``every`` it stops when all that is there now was read."""
        if "label" not in stream.columns:
            stream = stream.withColumn("label", F.lit(None).cast("string"))
        writer = new_elements(stream, self.within).writeStream.queryName(self.name).foreachBatch(self._take).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def run(self, stream: DataFrame, timeout: float | None = None) -> None:
        """One logged run over all that is there now; an error is logged and raised."""
        spark = self.store.spark
        before = set(self.batches)

        def counts() -> tuple[int, int]:
            mine = [b for k, b in self.batches.items() if k not in before]
            return sum(found for found, _ in mine), sum(change.added for _, change in mine)

        listener = _Listener(self.name, self.log, counts)
        spark.streams.addListener(listener)
        try:
            self.start(stream).awaitTermination(timeout)
        finally:
            listener.ended.wait(60)  # it hears of the end a little later
            spark.streams.removeListener(listener)

    def run_if_due(self, stream: DataFrame, now: Column, hours: float) -> bool:
        """``run`` if the last success is that long ago; says whether it ran."""
        if not self.log.due(now, hours):
            return False
        self.run(stream)
        return True
