"""The library in buckets, elements as a stream, and the log of runs."""

import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from quillmark.sources import store as stores
from quillmark.streaming import intake

AD = "id string, seq long, ts timestamp, title string, domain string, category string, confidence double, method string, needs_review int"
ELEMENT = "element string, " + AD + ", label string"
T = lambda d, h=0: datetime.datetime(2024, 1, d, h)
STAMP = "%Y-%m-%dT%H:%M:%S"


def sighting(element, ad, seq, ts, label=None):
    return (element, ad, seq, ts, f"title {ad} {seq}", f"{ad}.in", "model", 0.4, "lexical", 1, label)


def plain(*batches):
    """What batches of elements make of an empty library: a new ad counts once in its first batch, labels come last."""
    seen, ads = set(), {}
    for batch in batches:
        new, labels = set(), []
        for element, ad, seq, ts, title, domain, category, confidence, method, review, label in sorted(batch, key=lambda e: e[2]):
            if (element or (ad, seq)) in seen:
                continue
            seen.add(element or (ad, seq))
            at = ts.strftime(STAMP)
            if label is not None:
                labels.append((ad, label))
            elif ad in ads and ad not in new:
                ads[ad].update(last_seen=at, times_seen=ads[ad]["times_seen"] + 1)
            elif ad not in ads:
                new.add(ad)
                ads[ad] = {"id": ad, "title": title, "domain": domain, "first_seen": at, "last_seen": at, "times_seen": 1, "category": category, "confidence": confidence, "method": method, "needs_review": review, "manual_label": 0}
        for ad, label in labels:
            if ad in ads:
                ads[ad].update(category=label, confidence=1.0, method="manual", needs_review=0, manual_label=1)
    return ads


def taken(library):
    return {r.id: {k: v for k, v in r.asDict().items() if v is not None} for r in library.read().collect()}


def put(spark, folder, rows):
    spark.createDataFrame(rows, ELEMENT).coalesce(1).write.mode("append").parquet(folder)


def files(folder):
    return {str(p) for p in pathlib.Path(folder, "data").rglob("*.parquet")}


def library_rows(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("2024-01-01T00:00:00").alias("first_seen"), F.lit("2024-01-01T00:00:00").alias("last_seen"), F.lit(1).cast("long").alias("times_seen"), F.lit(0).alias("manual_label"), F.lit("a").alias("category"), *[F.lit(None).cast(t).alias(c) for c, t in [x.split() for x in stores.COLUMNS.split(", ")] if c not in ("id", "first_seen", "last_seen", "times_seen", "manual_label", "category")])


def test_a_change_touches_its_buckets_alone(spark, tmp_path):
    folder = str(tmp_path / "lib")
    library = stores.LibraryStore(spark, folder, buckets=32)
    assert library.read().count() == 0 and library.read().columns == [c.split()[0] for c in stores.COLUMNS.split(", ")]
    assert library.seed(library_rows(spark, 2000)) == stores.Change(32, 2000)
    assert library.seed(library_rows(spark, 10)) == stores.Change() and library.read().count() == 2000
    before, old = files(folder), library.live().versions
    assert len(before) == 32
    batch = spark.createDataFrame([("7", 1, "2024-02-01T00:00:00"), ("7", 2, "2024-02-02T00:00:00"), ("new", 3, "2024-02-03T00:00:00"), (None, 4, "")], "id string, seq long, ts string")
    touched = {r[0] for r in batch.where("id is not null").select(library.bucket(F.col("id"))).collect()}
    assert library.merge(batch, "b:1") == stores.Change(len(touched), 1)
    assert len(files(folder) - before) == len(touched) and {b for b, v in library.live().versions.items() if old.get(b) != v} == touched
    got = {r.id: (r.times_seen, r.last_seen) for r in library.read().where("id in ('7', 'new', '8')").collect()}
    assert got == {"7": (3, "2024-02-02T00:00:00"), "new": (1, "2024-02-03T00:00:00"), "8": (1, "2024-01-01T00:00:00")}
    assert library.merge(batch, "b:1") == stores.Change() and library.read().where("id = '7'").first().times_seen == 3
    library.label(spark.createDataFrame([("7", "x", 1), ("unknown", "x", 1)], "id string, category string, ts long"))
    library.reclassify(spark.createDataFrame([("7", "y", 0.5, "m", True), ("8", "y", 0.5, "m", True)], "id string, category string, confidence double, method string, needs_review boolean"))
    assert {r.id: (r.category, r.manual_label) for r in library.read().where("id in ('7', '8')").collect()} == {"7": ("x", 1), "8": ("y", 0)}
    assert library.read().count() == 2001
    everything = sorted(map(tuple, library.read().collect()), key=repr)
    assert library.vacuum(1) > 0 and sorted(map(tuple, library.read().collect()), key=repr) == everything and len(files(folder)) == 32


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    library = stores.LibraryStore(spark, str(tmp_path / "lib"), buckets=4)
    library.seed(library_rows(spark, 50))
    batch = spark.createDataFrame([("7", 1, "2024-02-01T00:00:00"), ("n", 2, "2024-02-01T00:00:00")], "id string, seq long, ts string")

    def crash(self, done):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(stores.LibraryStore, "_commit", crash)
        with pytest.raises(RuntimeError):
            library.merge(batch, "b:1")
    assert library.read().count() == 50 and library.read().where("times_seen > 1").count() == 0
    (tmp_path / "lib" / "manifests" / "2").mkdir()  # begun and never committed
    assert library.merge(batch, "b:1").added == 1 and library.read().count() == 51 and library.live().number == 3
    assert library.vacuum(1) >= 2 and library.read().count() == 51


def test_elements_count_once_over_runs(spark, tmp_path):
    first = [sighting("p1#a", "a", 1, T(1)), sighting("p1#b", "b", 2, T(1)), sighting("p1#a", "a", 3, T(1, 1)), sighting(None, "c", 4, T(1, 2)), sighting(None, "c", 5, T(1, 2)), sighting("l1", "a", 6, T(1, 3), "people"), sighting("l2", "z", 7, T(1, 3), "nobody")]
    second = [sighting("p2#a", "a", 8, T(2)), sighting("p2#d", "d", 9, T(2)), sighting("p1#b", "b", 10, T(2, 1)), sighting("p3#b", "b", 11, T(1, 5)), sighting("l3", "d", 12, T(2, 2), "first"), sighting("l4", "d", 13, T(2, 2), "last")]
    folder = str(tmp_path / "in")
    library = stores.LibraryStore(spark, str(tmp_path / "lib"), buckets=4)
    log = intake.RunLog(spark, str(tmp_path / "runs"))
    state = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    intake.state_on_disk(spark)
    try:
        read = lambda: spark.readStream.schema(ELEMENT).parquet(folder)
        put(spark, folder, first)
        intake.Intake(library, log, str(tmp_path / "check")).run(read(), 120)
        assert taken(library) == plain(first)
        put(spark, folder, second)
        put(spark, folder, first)  # a replay
        again = intake.Intake(library, log, str(tmp_path / "check"))
        again.run(read(), 120)
        assert taken(library) == plain(first, second + first)
        assert taken(library)["a"]["category"] == "people" and taken(library)["d"]["category"] == "last"
        before = taken(library)
        again._take(spark.createDataFrame(second, ELEMENT), max(again.batches))  # a batch that runs again
        assert taken(library) == before
        runs = sorted((r.run, r.status, r.ads_found, r.new_ads) for r in log.runs().collect())
        assert [r[1:] for r in runs] == [("success", 4, 3), ("success", 3, 1)]
        now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
        assert not log.due(now, 10**6) and log.due(now, 1)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", state)


def test_runs_that_fail_or_find_nothing(spark, tmp_path):
    folder, log = str(tmp_path / "in"), intake.RunLog(spark, str(tmp_path / "runs"))
    library = stores.LibraryStore(spark, str(tmp_path / "lib"), buckets=2)
    put(spark, folder, [sighting("p1#a", "a", 1, T(1))])
    read = lambda: spark.readStream.schema(ELEMENT).parquet(folder)
    assert log.runs().count() == 0 and log.due(F.lit("2024-01-01").cast("timestamp_ntz"), 1)

    def broken(ads):
        raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        intake.Intake(library, log, str(tmp_path / "check"), classify=broken).run(read(), 120)
    assert library.read().count() == 0
    works = intake.Intake(library, log, str(tmp_path / "check"), classify=lambda ads: ads.withColumn("category", F.lit("told")))
    works.run(read(), 120)
    assert taken(library)["a"]["category"] == "told"
    works.run(read(), 120)  # nothing new
    statuses = [r.status for r in sorted(log.runs().collect(), key=lambda r: r.started_at)]
    assert statuses == ["failed", "success", "failed"] and log.runs().where("log like '%no model%'").count() == 1
