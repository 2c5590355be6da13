"""Exact top-k inner products with a pivot table.

Vectors are rounded down to integers, so scores are exact.  For a query q and
a candidate x, ``2 q.x = |q|**2 + |x|**2 - d(q, x)**2``, and for each pivot p
``d(q, x) >= |d(q, p) - d(x, p)|``: the largest difference over many pivots, all
distances computed once, bounds the score from above.  A query takes candidates
in the order of their bounds and stops when the next bound is below its k-th
score; candidates that could still tie are looked at.

Queries and candidates are dealt into blocks; every query block meets every
candidate block in a task of its own size, keeps k rows a query there, and a
query's rows are merged by rank.  A block holds a fixed number of rows, so
neither tasks nor the driver hold a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.store import materialize

RESULT = "query_id long, vec_id long, score long"


def integers(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component; null where the vector is null or has a null or non-finite one."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(whole, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def top_of_block(query_ids, queries: np.ndarray, ids, vectors: np.ndarray, pivots: np.ndarray, k: int, step: int = 256) -> pd.DataFrame:
    """Each query's k best of one block, ties to the smaller id, without the query's own id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]

    def distances(rows):
        # integers below 2**53: the squares are exact
        squares = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * rows @ pivots.T
        return np.sqrt(np.maximum(squares, 0))

    table, own = distances(vectors), distances(queries)
    lengths, query_lengths = (vectors * vectors).sum(1), (queries * queries).sum(1)
    found: list[pd.DataFrame] = []
    for query_id, q, length, at in zip(query_ids, queries, query_lengths, own, strict=True):
        low = np.abs(table - at).max(1) * (1 - 1e-12) - 1e-9  # rounding can't lift a bound over the distance
        upper = (length + lengths - np.square(np.maximum(low, 0))) / 2
        upper[ids == query_id] = -np.inf
        by_bound = np.argsort(-upper, kind="stable")
        taken = np.empty(0, np.int64)
        scores = np.empty(0, np.float64)
        worst = -np.inf
        for start in range(0, len(ids), step):
            if start and upper[by_bound[start]] < worst:
                break
            block = by_bound[start : start + step]
            block = block[np.isfinite(upper[block]) & (upper[block] >= worst)]
            scores = np.concatenate((scores, vectors[block] @ q))
            taken = np.concatenate((taken, block))
            best = np.lexsort((ids[taken], -scores))[:k]
            taken, scores = taken[best], scores[best]
            if len(taken) == k:
                worst = scores[-1]
        found.append(pd.DataFrame({"query_id": np.full(len(taken), query_id), "vec_id": ids[taken], "score": scores.astype(np.int64)}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def _meet(k: int, pivots: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        parts = []
        rights = {}
        widths = right["width"].to_numpy()
        for width in set(widths.tolist()):
            part = right.filter(pa.array(widths == width))
            vectors = part["vector"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width)
            ids = part["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            # pivots far from one another, from the candidates at hand
            chosen = [vectors[order[0]]]
            gap = np.full(len(vectors), np.inf)
            while len(chosen) < min(pivots, len(vectors)):
                gap = np.minimum(gap, np.square(vectors - chosen[-1]).sum(1))
                if gap.max() == 0:
                    break
                chosen.append(vectors[int(gap.argmax())])
            rights[width] = (ids, vectors, np.array(chosen))
        widths = left["width"].to_numpy()
        for width in set(widths.tolist()) & set(rights):
            part = left.filter(pa.array(widths == width))
            queries = part["vector"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width)
            ids, vectors, chosen = rights[width]
            parts.append(top_of_block(part["vec_id"].to_numpy(), queries, ids, vectors, chosen, k))
        if not parts:
            return schema.empty_table()
        return pa.Table.from_pandas(pd.concat(parts), schema=schema, preserve_index=False)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 32, block_rows: int = 4096, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query row.

    ``vectors`` has vec_id and embedding.  Rows whose vector is null, empty or
    has a null or non-finite component take no part, nor do rows without an id.
    Vectors of different lengths don't meet.  All rows but the query's own id
    are candidates; ties go to the smaller id; with fewer than k candidates all
    are returned.  Repeated rows are candidates each; a repeated query id asks once, with
    its smallest vector.  Other columns are ignored.
    """
    rows = vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("vector"), "is_query")
    rows = rows.where("vec_id is not null and vector is not null and size(vector) > 0").withColumn("width", F.size("vector"))
    rows = materialize(rows, "vectors")
    n, queries = (rows.agg(F.count("*"), F.count_if("is_query")).collect() or [(0, 0)])[0]
    n_blocks, n_query_blocks = max(1, -(-n // block_rows)), max(1, -(-queries // query_rows))
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(n_query_blocks)).cast("int")
    candidates = rows.withColumn("block", block).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    asked = rows.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("width", F.size("vector")).withColumn("query_block", query_block).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    columns = ["query_block", "block", "vec_id", "width", "vector"]
    met = asked.select(columns).groupBy("query_block", "block").cogroup(candidates.select(columns).groupBy("query_block", "block")).applyInArrow(_meet(k, pivots), RESULT)
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
