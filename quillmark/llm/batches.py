"""Arrow batches in small parts, so that a task holds few texts as Python strings at once and leaves little behind."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 256
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of at most ``rows``; empty batches go. Behind the last one memory is released."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    del batches
    release()


def few_at_once(spark: SparkSession) -> None:
    """From here on this session hands Python at most ROWS rows at once.

    Spark's default of 10,000 rows is tens of MB of texts or shingle sets for
    each task, held by the executor and by its Python worker at the same time.
    A smaller number that the session has stays.
    """
    now = int(spark.conf.get(ROWS_SETTING))
    if not 0 < now <= ROWS:
        spark.conf.set(ROWS_SETTING, str(ROWS))


def release() -> None:
    """Hands memory that a task no longer uses back to the system: its worker process lives on and serves other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def values(array: pa.Array, rows: int = ROWS) -> Iterator:
    """The values of an array as Python objects, converted in parts."""
    for at in range(0, len(array), rows):
        yield from array.slice(at, rows).to_pylist()
