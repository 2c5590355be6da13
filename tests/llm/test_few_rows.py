"""Stages hand Python few rows at once."""

import pyarrow as pa
import pytest

import corpus_pipeline
from quillmark.llm import batches
from tests.conftest import SF


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_hand_python_few_rows(spark, name):
    def rows(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])], ["n"])

    before = spark.conf.get(batches.ROWS_SETTING)
    try:
        spark.conf.set(batches.ROWS_SETTING, "10000")
        dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF)
        counts = [r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(rows, "n long").collect()]
        assert sum(counts) == 3000 and max(counts) <= batches.ROWS
        spark.conf.set(batches.ROWS_SETTING, "100")
        batches.few_at_once(spark)
        assert spark.conf.get(batches.ROWS_SETTING) == "100"
    finally:
        spark.conf.set(batches.ROWS_SETTING, before)
