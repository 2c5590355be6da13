"""Connected components by joins, for graphs that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.store import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that an edge names.

    Alternates two steps until nothing changes: each node's larger neighbours
    are tied to its smallest neighbour, then each node's smaller neighbours are.
    Every step is a grouped minimum (combined before the shuffle) and a join,
    so a node with very many neighbours is no single task's load.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links = materialize(both, "links")
    while True:
        sides = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = materialize(small, "small-star")
        # a fixed point: every node is tied to one smaller node, which is tied to none
        tied_twice = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        chained = tied_twice or after.alias("x").join(after.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").limit(1).count()
        links = after
        if not chained:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
