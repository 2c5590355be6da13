import datetime

from quillmark.operators import library
from quillmark.streaming import sightings

DAY = lambda d: datetime.datetime(2024, 1, d)
BATCH = "id long, seq long, ts timestamp_ntz, category string"


def test_merge_counts_as_specified(spark):
    empty = spark.createDataFrame([], sightings.LIBRARY)
    first = library.merge(empty, spark.createDataFrame([(1, 1, DAY(3), "a"), (1, 2, DAY(4), "b")], BATCH))
    assert [tuple(r) for r in first.collect()] == [(1, DAY(3), DAY(3), 1, "a")]
    again = library.merge(first, spark.createDataFrame([(1, 3, DAY(2), "c"), (1, 4, DAY(1), "d"), (2, 5, DAY(9), "e")], BATCH))
    assert sorted(tuple(r) for r in again.collect()) == [(1, DAY(3), DAY(1), 3, "a"), (2, DAY(9), DAY(9), 1, "e")]


def test_labels_stick(spark):
    lib = spark.createDataFrame([(1, DAY(1), DAY(1), 1, "a")], sightings.LIBRARY)
    done = library.labelled(lib, spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, category string, ts long"))
    assert [(r.category, r.manual_label) for r in done.collect()] == [("y", 1)]
