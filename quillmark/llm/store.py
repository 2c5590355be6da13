"""Shared storage for intermediate tables.

Long jobs cut their lineage with a Parquet table in the folder that the
cluster names in ``spark.checkpoint.dir``: every executor sees it, and it
outlives the executor that wrote it.  Where the setting is missing a local
session (tests, a laptop) uses a folder of the driver; a cluster is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than this share of all rows are split; there are at most as many as its inverse.
HOT_SHARE = 1 / 1000

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="quillmark-")
    return _local["dir"]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/quillmark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def join_facts(rows: DataFrame, facts: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """The rows with the facts of their key, whose column ``n`` says how many rows have it.

    Keys that hold more than HOT_SHARE of the ``total`` rows, at most 1000, are
    looked up where their rows lie; only rows of other keys are shuffled.
    """
    most = max(1000.0, total * HOT_SHARE)
    hot = F.broadcast(facts.where(F.col(n) > most))  # 1000 rows at most
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(facts.where(F.col(n) <= most), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
