"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child of the
current node draws ``ln(u) / weight`` with ``u`` hashed from the row's key,
the level and the child; the largest draw wins.  A child is so chosen with
probability proportional to its weight, and a change of one child's weight
only moves rows into or out of that child: movement stays within subtrees
whose weights changed.  A shard that opens a region of its own therefore takes
rows only into itself.

DataFrame functions only; nothing but ids, sizes and checksums is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.store import materialize


@dataclass(frozen=True)
class HashTree:
    """``shards`` leaves, dealt in order to racks and regions of fixed width.

    ``weights`` maps a shard to its capacity (1.0 where it is missing); a
    rack's weight is the sum of its shards', a region's the sum of its racks'.
    """

    shards: int = 16
    shards_per_rack: int = 4
    racks_per_region: int = 2
    weights: dict[int, float] = field(default_factory=dict)

    def __post_init__(self):
        if self.shards < 1:
            raise ValueError("a tree needs at least one shard")
        if any(w <= 0 for w in self.weights.values()):
            raise ValueError("weights must be positive")

    def shard_weights(self) -> list[float]:
        return [float(self.weights.get(s, 1.0)) for s in range(self.shards)]

    def levels(self) -> list[tuple[str, list[tuple[int, int]], list[float]]]:
        """For each level: its name, the children of each parent as (first, count), the children's weights."""
        leaf = self.shard_weights()
        racks = math.ceil(self.shards / self.shards_per_rack)
        rack = [sum(leaf[r * self.shards_per_rack : (r + 1) * self.shards_per_rack]) for r in range(racks)]
        regions = math.ceil(racks / self.racks_per_region)
        region = [sum(rack[g * self.racks_per_region : (g + 1) * self.racks_per_region]) for g in range(regions)]

        def span(parents: int, children: int, width: int) -> list[tuple[int, int]]:
            return [(p * width, min(width, children - p * width)) for p in range(parents)]

        return [
            ("region", [(0, regions)], region),
            ("rack", span(regions, racks, self.racks_per_region), rack),
            ("shard", span(racks, self.shards, self.shards_per_rack), leaf),
        ]

    def grown(self) -> "HashTree":
        return HashTree(self.shards + 1, self.shards_per_rack, self.racks_per_region, self.weights)


def _draw(key: Column, level: str, child: Column, weight: Column) -> Column:
    """``ln(u) / weight`` with u in (0, 1] from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(level), child.cast("string"))), 1, 13), 16, 10).cast("long")
    return F.log((bits + 1) / F.lit(float(2**52))) / weight


def _heaviest(key: Column, level: str, first: Column, count: Column, weight: Column):
    """A function from a node to the child of it with the largest draw, ties to the smaller child."""

    def drawn(child: Column) -> Column:
        return F.struct(_draw(key, level, child, F.element_at(weight, child + 1)).alias("draw"), (-child).alias("order"))

    def descend(at: Column) -> Column:
        lo = F.element_at(first, at + 1)
        return -F.array_max(F.transform(F.sequence(lo, lo + F.element_at(count, at + 1) - 1), drawn))["order"]

    return descend


def place(key: Column, tree: HashTree) -> Column:
    """The shard of a row with this (string) key."""
    node = F.lit(0)
    for level, spans, weights in tree.levels():
        first = F.array(*[F.lit(a) for a, _ in spans])
        count = F.array(*[F.lit(n) for _, n in spans])
        weight = F.array(*[F.lit(w) for w in weights])

        # transform over one element binds the parent, so that it is computed once
        node = F.transform(F.array(node), _heaviest(key, level, first, count, weight))[0]
    return node


def row_key(doc_id: Column, text: Column) -> Column:
    """The id decides; rows without one are spread by their text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def shard_rows(df: DataFrame, tree: HashTree | None = None, doc_id: str = "doc_id", text: str = "text", chunks: int = 256) -> DataFrame:
    """Shard, size, checksum and a gapless slot for every row of ``df``.

    Slots are numbered per (shard, chunk of the key's digest), then lifted by
    the counts of the chunks before, so no task orders a whole shard.  The
    counts that are joined back have ``shards * chunks`` rows at most.

    Null text: size 1, the checksum of no bytes.  Null id: placed by the text.
    Equal ids share a shard.  Rows equal in all columns get slots in any order.
    An empty table gives no rows.  Other columns of ``df`` are ignored.
    """
    tree = tree or HashTree()
    body = F.coalesce(F.col(text), F.lit(""))
    key = row_key(F.col(doc_id), F.col(text))
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        place(key, tree).cast("int").alias("shard"),
        place(key, tree.grown()).cast("int").alias("grown_shard"),
        (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % chunks).cast("int").alias("chunk"),
    )
    rows = materialize(rows, "shards")
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    # at most shards * chunks rows, whatever the input
    before = F.coalesce(F.expr("sum(n) over (partition by shard order by chunk rows between unbounded preceding and 1 preceding)"), F.lit(0))
    offsets = counts.select("shard", "chunk", before.alias("before"))
    rank = F.expr("row_number() over (partition by shard, chunk order by doc_id, text_crc32, size)")
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(offsets), ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )


def attach_shards(df: DataFrame, tree: HashTree | None = None, doc_id: str = "doc_id", text: str = "text", name: str = "shard") -> DataFrame:
    """``df`` with its shard as a further column (replacing one of that name), without a shuffle."""
    return df.withColumn(name, place(row_key(F.col(doc_id), F.col(text)), tree or HashTree()).cast("int"))


def write_shards(df: DataFrame, path: str, tree: HashTree | None = None, doc_id: str = "doc_id", text: str = "text", files_per_shard: int = 8) -> None:
    """Write ``df`` as one folder of Parquet files for each shard."""
    placed = attach_shards(df, tree, doc_id, text)
    salt = F.pmod(F.xxhash64(doc_id, text), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
