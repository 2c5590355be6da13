"""A library of ads that is changed in place: buckets by id, and a manifest that says which version of each is live.

Every change reads and writes the buckets of its ids alone.  Their new versions
are written first; the manifest, one small table of (bucket, version), is
written last and in one file, whose commit is the change.  Readers see the
newest manifest, so a job that dies on the way leaves the library as it was.
A change may carry a name, such as a stream and its batch; a name that the
manifest already has is skipped, so a batch that runs again changes nothing.

One writer at a time: the second of two that start from one manifest fails,
since the next manifest exists.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import library

#: All columns of an ad in the library.
COLUMNS = (
    "id string, title string, description string, advertiser string, landing_url string, domain string, image_url string, network string, source_page string, first_seen string, last_seen string, "
    "times_seen long, category string, confidence double, method string, needs_review int, manual_label int"
)
MANIFEST = "bucket int, version string, name string, added int"


@dataclass(frozen=True)
class Live:
    """The newest manifest: its number, the version of each bucket, and the names of the last changes with the numbers they made."""

    number: int
    versions: dict[int, str]
    names: dict[str, int]
    next: int


@dataclass(frozen=True)
class Change:
    """How many buckets a change wrote, and by how many ads the library grew."""

    buckets: int = 0
    added: int = 0


class LibraryStore:
    """``buckets`` bounds the manifest; a bucket should fit one task, or ``files`` tasks."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = COLUMNS, buckets: int = 64, files: int = 1, remembered_names: int = 1000):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.buckets, self.files, self.remembered_names = buckets, files, remembered_names

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    # -- reading
    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, *parts: str) -> list[str]:
        path, files = self._path(*parts)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _begun(self) -> list[int]:
        return sorted(int(n) for n in self._listed("manifests") if n.isdigit())

    def manifests(self) -> list[int]:
        """Numbers of the manifests that were committed."""
        return [n for n in self._begun() if "_SUCCESS" in self._listed("manifests", str(n))]

    def live(self) -> Live:
        numbers = self.manifests()
        free = max(self._begun(), default=0) + 1  # behind one that was begun and never committed
        if not numbers:
            return Live(0, {}, {}, free)
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{numbers[-1]}").collect()  # buckets and names: bounded
        return Live(numbers[-1], {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}, {r["name"]: r["added"] for r in rows if r["name"] is not None}, free)

    def _read(self, live: Live, buckets: list[int]) -> DataFrame:
        paths = [f"{self.folder}/data/{live.versions[b]}/bucket={b}" for b in buckets if b in live.versions]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The library as the newest manifest has it."""
        live = self.live()
        return self._read(live, sorted(live.versions))

    # -- changing
    def change(self, rows: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], name: str | None = None) -> Change:
        """``apply(old, rows)`` for the buckets of the ids in ``rows``.

        ``apply`` must keep each id in the library's schema.  Rows without an id go.
        """
        live = self.live()
        if name is not None and name in live.names:
            return Change()
        rows = rows.where("id is not null")
        touched = sorted(r[0] for r in rows.select(self.bucket(F.col("id")).alias("b")).distinct().collect())  # at most ``buckets`` numbers
        version = uuid.uuid4().hex
        if touched:
            after = apply(self._read(live, touched), rows)
            dealt = after.withColumn("bucket", self.bucket(F.col("id")))
            # a stated number: adaptive execution would coalesce buckets, and partitionBy would then write small files
            dealt = dealt.repartition(min(len(touched) * self.files, 4096), "bucket", *([F.pmod(F.xxhash64("id", F.lit(1)), F.lit(self.files))] if self.files > 1 else []))
            dealt.write.partitionBy("bucket").parquet(f"{self.folder}/data/{version}")
            written = {int(n.split("=")[1]) for n in self._listed("data", version) if n.startswith("bucket=")}
        else:
            written = set()
        versions = {b: v for b, v in live.versions.items() if b not in touched} | {b: version for b in written}
        done = Live(live.next, versions, live.names | ({name: live.next} if name else {}), live.next + 1)
        # rows are counted in the files' footers
        added = self._read(done, touched).count() - self._read(live, touched).count() if touched else 0
        self._commit(done)
        return Change(len(written), added)

    def _commit(self, done: Live) -> None:
        names = sorted(done.names.items(), key=lambda e: e[1])[-self.remembered_names :]
        rows = [(b, v, None, None) for b, v in sorted(done.versions.items())] + [(None, None, n, k) for n, k in names]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/manifests/{done.number}")

    def merge(self, batch: DataFrame, name: str | None = None) -> Change:
        """Counts sightings (id, seq, ts, ..): see ``library.merge``."""
        return self.change(batch, library.merge, name)

    def label(self, corrections: DataFrame, name: str | None = None) -> Change:
        """Sets human labels (id, category, ts) of ads that the library has."""
        return self.change(corrections, library.labelled, name)

    def reclassify(self, answers: DataFrame, name: str | None = None) -> Change:
        """Takes new answers where no person has set a label."""
        return self.change(answers, library.reclassified, name)

    def replace(self, rows: DataFrame, name: str | None = None) -> Change:
        """Takes whole rows, one for each id, in place of those with the same id."""
        return self.change(rows, lambda old, new: old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns)), name)

    def seed(self, rows: DataFrame) -> Change:
        """Takes whole rows if the library is empty; otherwise does nothing."""
        return Change() if self.read().limit(1).count() else self.replace(rows)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what the last ``keep`` manifests don't name; returns how many folders went."""
        numbers = self.manifests()
        kept: set[tuple[str, str]] = set()
        for n in numbers[-keep:]:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{n}").where("bucket is not null").collect()
            kept.update((r["version"], f"bucket={r['bucket']}") for r in rows)
        gone = [("manifests", str(n)) for n in self._begun() if n not in numbers[-keep:]]
        for version in self._listed("data"):
            held = [b for b in self._listed("data", version) if (version, b) in kept]
            gone += [("data", version, b) for b in self._listed("data", version) if b.startswith("bucket=") and b not in held] if held else [("data", version)]
        for parts in gone:
            path, files = self._path(*parts)
            files.delete(path, True)
        return len(gone)
