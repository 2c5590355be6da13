"""Near-duplicate classes by MinHash with tensored banding.

A table key joins the hashes of two collections.  ``collections`` small
collections of ``width`` minhashes give ``collections * (collections - 1) / 2``
tables of ``2 * width`` hashes, for about the square root of the minhashes that
as many separate tables would need.  Two texts share a key exactly if two of
their collections agree, so collections that agree with no other text's are
dropped before any key is formed.

Steps:

1. equal texts are one text (grouped by digest, combined before the shuffle);
2. each text is reduced to its shingle count and its collections' hashes;
3. collections shared by two texts or more are kept, as one row for each text;
   two texts share a key exactly if they share two collections;
4. rounds: each collection that holds several components names a root, and every
   text is compared with the root, of another component, with which it shares
   most collections, two at least; what is confirmed on full shingle sets joins
   components, and collections that lie in one component are left out from then on;
5. what shares two of the collections left forms families: rounds, without looking
   at shingles, tie each text to all roots with which it shares two; a collection's
   roots are of the families with the fewest and the most of its texts: a large family
   meets each small one in many texts, of which one tie is enough; only collections
   that still hold several families are then paired into keys, which tie what is left;
   a family is dealt into blocks of bounded size, and
   every two blocks are compared in a task of their own, which looks at the pairs
   that share a key and yields only links between components;
6. components of all confirmed links.

Rounds are linear in the texts and join what is near, so that a large group of
copies is one component before any key of it is formed; step 5 then covers every
pair that shares a key and isn't connected yet, so no link of a candidate pair is
lost, however large a bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import small
from quillmark.llm.components import components
from quillmark.llm.shingles import shingle_set
from quillmark.llm.store import materialize

#: 36 collections of 4 make 630 tables of 8 hashes from 144 minhashes; two texts of similarity 0.75 share no key in 2 of 100,000 cases, of 0.85 in 1 of 10**10.
COLLECTIONS = 36
WIDTH = 4
SHINGLE = 5
PERCENT = 75
ROUNDS = 2
#: Rounds within families end when at most this many keys for each text are left, or after FAMILY_ROUNDS; all that are left are formed.
FAMILY_ROUNDS = 6
KEYS_EACH = 8
#: A family's blocks hold about this many texts and shingles (8 bytes each).
BLOCK_TEXTS = 1024
BLOCK_SHINGLES = 2_000_000
#: Texts in buckets up to this number (16 MB of digests) are found by broadcast, more by shuffling.
BROADCAST_TEXTS = 500_000


def _multipliers(n: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, collections: int, width: int) -> np.ndarray:
    """One hash for each collection: its ``width`` minhashes joined."""
    a = _multipliers(collections * width)
    least = np.full(collections * width, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            products = a[:, None] * shingles[None, at : at + 1024]
            # multiply-shift: the upper halves of the products
            np.minimum(least, products.view("<u4")[:, 1::2].min(axis=1), out=least)
        joined = np.zeros(collections, np.uint64)
        for k in range(width):
            joined = (joined ^ least[k::width].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            joined ^= joined >> np.uint64(31)
    return joined.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], collections: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        sizes, hashes = [], []
        for text in batch["text"].to_pylist():
            shingles = shingle_set(text, SHINGLE)
            sizes.append(len(shingles))
            hashes.append(signature(shingles, collections, width) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tid"], pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "tid", "n_shingles", "halves"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        packed = [shingle_set(t, SHINGLE).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["sid"], pa.array(packed, pa.binary())], ["sid", "shingles"])


def _similar(x: pa.Scalar, y: pa.Scalar, percent: int) -> bool:
    """Whether two sets of sorted 64-bit hashes share enough."""
    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full sets are similar enough."""
    for batch in batches:
        kept = [k for k, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)) if _similar(x, y, percent)]
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b), compared on the full shingle sets of both texts."""
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long")
    return materialize(links, "confirmed")


def shared(sketches: DataFrame) -> DataFrame:
    """(sid, own): the collections of each text that other texts have too, if there are two or more."""
    halves = sketches.where("n_shingles > 0").select("sid", F.posexplode("halves").alias("place", "half")).select("sid", F.xxhash64("place", "half").alias("c"))
    held = halves.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    return halves.join(held, "c").groupBy("sid").agg(F.collect_list("c").alias("own")).where("size(own) > 1")


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _placed(table: DataFrame, links: DataFrame) -> DataFrame:
    """``table`` with each text's component under these links."""
    found = components(links).select(F.col("node").alias("sid"), F.col("component").alias("new"))
    return table.join(found, "sid", "left").withColumn("component", F.coalesce("new", "component")).drop("new")


def _unsettled(table: DataFrame) -> DataFrame:
    """The texts with those of their collections that lie in several components, if there are two or more."""
    each = table.select("sid", "n_shingles", "component", F.explode("own").alias("c"))
    several = each.groupBy("c").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("c")
    return each.join(several, "c").groupBy("sid", "n_shingles", "component").agg(F.collect_list("c").alias("own")).where("size(own) > 1")


def _round(table: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each text with one text of another component: the root, of a collection, with which it shares most collections, two at least."""
    each = table.select("sid", "n_shingles", "component", F.explode("own").alias("c"))
    order = F.struct(F.xxhash64(F.lit(turn), "sid").alias("by"), "sid", "component", "n_shingles")
    roots = each.groupBy("c").agg(F.min(order).alias("r")).select("c", F.col("r.sid").alias("root"), F.col("r.component").alias("root_component"), F.col("r.n_shingles").alias("root_n"))
    met = each.join(roots, "c").where((F.col("component") != F.col("root_component")) & _sizes_allow("n_shingles", "root_n", percent))
    counted = met.groupBy("sid", "root").agg(F.count("*").alias("n")).where("n > 1")
    nearest = counted.groupBy("sid").agg(F.max(F.struct("n", "root")).alias("m"))
    return nearest.select(*_pair(F.col("sid"), F.col("m.root"))).distinct()


def _ties(each: DataFrame, turn: int) -> DataFrame:
    """(a, b), both ways: families of which a text shares two collections with a root of the other's; a collection's roots are of the families with the fewest and the most of its texts."""
    held = each.groupBy("c", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(turn), "sid").alias("by"), "sid")).alias("r"))
    root, by = F.struct("r.sid", "component"), F.struct("n", F.xxhash64(F.lit(turn), "component"))
    roots = held.groupBy("c").agg(F.array(F.min_by(root, by), F.max_by(root, by)).alias("r")).select("c", F.explode(F.array_distinct("r")).alias("r"))
    roots = roots.select("c", F.col("r.sid").alias("root"), F.col("r.component").alias("root_component"))
    met = each.join(roots, "c").where("component <> root_component").groupBy("sid", "component", "root", "root_component").agg(F.count("*").alias("n"))
    found = met.where("n > 1").select(F.col("component").alias("a"), F.col("root_component").alias("b")).distinct()
    return found.union(found.select("b", "a"))


def _untied(each: DataFrame, ties: DataFrame) -> DataFrame:
    """The rows (sid, component, c) of texts that hold two collections, or more, of several families each.

    A family takes the least of what it is tied to, and once more what that
    takes; what is still apart then meets again in the next round.
    """
    least = materialize(ties.groupBy("a").agg(F.least("a", F.min("b")).alias("b")), "least")
    new = least.join(least.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select(F.col("a").alias("component"), F.col("c").alias("new"))
    placed = each.join(new, "component", "left").select("sid", F.coalesce("new", "component").alias("component"), "c")
    several = placed.groupBy("c").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("c")
    open_ = materialize(placed.join(several, "c").select("sid", "component", "c"), "open")
    two = open_.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1").select("sid")
    return materialize(open_.join(two, "sid", "left_semi"), "untied")


def _families(table: DataFrame, rounds: int = FAMILY_ROUNDS) -> DataFrame:
    """(sid, family): what shares two collections, each of several components, directly or by others.

    Rounds first tie what is near, at most two rows for each text and collection
    of its own.  Two texts of different families that share two collections keep
    both, since these hold several families, so the keys lose no tie.
    """
    each, ties = materialize(table.select("sid", F.col("sid").alias("component"), F.explode("own").alias("c")), "each"), None
    texts = table.count()
    for turn in range(rounds):
        more = materialize(_ties(each, turn), "ties")
        ties = more if ties is None else ties.union(more)
        each = _untied(each, more)
        held = each.groupBy("sid").agg(F.count("*").alias("n"))
        if held.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0))).first()[0] <= 2 * KEYS_EACH * texts:
            break
    left = each.groupBy("sid", "component").agg(F.collect_list("c").alias("own"))
    rest = _key_ties(left).select(F.col("sid").alias("a"), F.col("root").alias("b"))
    return components(rest if ties is None else rest.union(ties)).select(F.col("node").alias("sid"), F.col("component").alias("family"))


def _key_ties(table: DataFrame) -> DataFrame:
    """(sid, root): each text with the smallest of every key of several components; a key is a pair of a text's collections."""
    pairs = F.expr("flatten(transform(array_sort(own), (x, i) -> transform(slice(array_sort(own), i + 2, size(own)), y -> xxhash64(x, y))))")
    keys = materialize(table.select("sid", "component", F.explode(pairs).alias("key")), "keys")
    held = keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("sid").alias("root")).where("low <> high").select("key", "root")
    return keys.join(held, "key").select("sid", "root").distinct()


def classes(sketches: DataFrame, sets: DataFrame, table: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(sid, component) of every text that a confirmed link names.

    ``sketches`` has sid, n_shingles and halves, ``table`` the rows of ``shared``,
    ``sets`` the shingle set of each text of ``table``.
    """
    table = table.join(sketches.select("sid", "n_shingles"), "sid").withColumn("component", F.col("sid"))
    links = None
    for turn in range(rounds):
        more = _confirmed(_round(table, turn, percent), sets, percent)
        links = more if links is None else links.union(more)
        table = materialize(_unsettled(_placed(table.drop("component").withColumn("component", F.col("sid")), links)), "unsettled")
    nodes = table.select("sid", "n_shingles", "component").join(_families(table), "sid").join(sketches.select("sid", "halves"), "sid")
    return components(links.union(_across(materialize(nodes, "families"), sets, percent))).select(F.col("node").alias("sid"), "component")


def _across(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each family, found block by block."""
    shape = nodes.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("s") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_TEXTS)).cast("int")
    dealt = nodes.join(shape.select("family", blocks.alias("blocks")), "family").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    full = dealt.join(sets, "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["block", "sid", "n_shingles", "component", "halves", "shingles"]
    met = full.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *columns)
    links = met.groupBy("family", "i", "j").applyInArrow(lambda key, rows: _compare(key, rows, percent), "a long, b long")
    return materialize(links, "across")


def _compare(key: tuple, rows: pa.Table, percent: int) -> pa.Table:
    """Links that join the components of two blocks (or within one), those of most common collections first; those that a link found before implies are left out."""
    rows = rows.sort_by("sid")
    block, sid, n, component = (rows[c].to_numpy() for c in ("block", "sid", "n_shingles", "component"))
    halves = np.stack(rows["halves"].to_numpy())
    shingles = rows["shingles"].combine_chunks()
    first = np.flatnonzero(block == key[1].as_py())
    second = first if key[1] == key[2] else np.flatnonzero(block == key[2].as_py())
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out: tuple[list, list] = ([], [])
    for at in range(0, len(first), 512):
        x = first[at : at + 512]
        common = np.zeros((len(x), len(second)), np.int16)
        for k in range(halves.shape[1]):
            common += halves[x, k][:, None] == halves[second, k][None, :]
        close = (common > 1) & (component[x][:, None] != component[second][None, :]) & (n[x][:, None] * 100 >= n[second][None, :] * percent) & (n[second][None, :] * 100 >= n[x][:, None] * percent)
        p, q = np.nonzero(close)
        for k in np.argsort(-common[p, q], kind="stable"):
            a, b = x[p[k]], second[q[k]]
            left, right = root(int(component[a])), root(int(component[b]))
            if left != right and _similar(shingles[int(a)], shingles[int(b)], percent):
                parent[left] = right
                out[0].append(min(int(sid[a]), int(sid[b])))
                out[1].append(max(int(sid[a]), int(sid[b])))
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def near_duplicates(docs: DataFrame, collections: int = COLLECTIONS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Null texts, texts without words and empty texts have an empty set, link
    with nothing and keep their own id.  Texts of fewer than five words are one
    shingle.  Rows of equal texts are one class; repeated ids stay as they are.
    A row without an id has the smallest id of its class, or none, and is kept
    only if its class has none.  Further columns are ignored; no rows give none.
    """
    return _classified(docs, collections, width, percent).drop("tid")


def _classified(docs: DataFrame, collections: int, width: int, percent: int) -> DataFrame:
    """As ``near_duplicates``, with the text's digest."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tid", F.unhex(F.md5("text")))
    schema = "doc_id long, tid binary, n_shingles long, halves array<long>"
    rows = materialize(texts.mapInArrow(lambda batches: _sketch(batches, collections, width), schema), "sketches")
    # each text is looked up in the row of its smallest id
    ids = rows.groupBy("tid", "doc_id", "n_shingles").agg(F.count("*").alias("n")).groupBy("tid", "n_shingles").agg(F.min(F.struct("doc_id", "n")).alias("at"), F.min("doc_id").alias("least"))
    ids = materialize(ids.select("tid", "n_shingles", "least", F.col("at.doc_id").alias("row_id"), "at.n").withColumn("sid", F.monotonically_increasing_id()), "ids")
    sketches = rows.select("tid", "halves").where("n_shingles > 0").dropDuplicates(["tid"]).join(ids, "tid")
    sketches = materialize(sketches.select("sid", "n_shingles", "halves"), "texts")
    table = materialize(shared(sketches), "shared")
    named = materialize(ids.join(table.select("sid"), "sid", "left_semi").select("sid", "tid", "row_id", "n"), "named")
    if named.count() <= BROADCAST_TEXTS:
        named = F.broadcast(named)
    found_in = texts.join(named.withColumnRenamed("tid", "own"), (F.col("tid") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("row_id")))
    sets = found_in.select("sid", "text", "n").mapInArrow(_sets, "sid long, shingles binary")
    if named.where("n > 1").limit(1).count():  # rows that are repeated throughout
        sets = sets.dropDuplicates(["sid"])
    found = classes(sketches, materialize(sets, "sets"), table, percent)
    known = materialize(ids.join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid")), "known")
    component_ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_text = known.join(component_ids, "component").select("tid", "component_id")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.select("doc_id", "tid", "n_shingles").join(by_text, "tid").select("doc_id", "tid", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their class of near-duplicates.

    That is the row of the smallest id; of rows without an id, those that have
    no other in their class stay.  Rows repeated throughout stay as often.
    """
    columns = docs.columns
    found = materialize(_classified(docs, COLLECTIONS, WIDTH, PERCENT), "classes")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")).distinct()
    gone = materialize(gone, "gone")
    if gone.count() <= BROADCAST_TEXTS:
        gone = F.broadcast(gone)
    tid = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs.withColumn("__own", tid).join(gone, (F.col("__own") == F.col("__tid")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti").select(*columns)
