"""The lexical model: TF-IDF of words and characters, balanced regression, and its cross-validation.

Terms are hashed to a fixed number of slots, words in one half and characters in
the other, so a model's size doesn't grow with the corpus.  A row's terms become
(slot, times) lists where the row lies; weights depend on the model and are made
in the tasks that use them.  The grams of characters are those of words, and few
words of a part differ, so each word is cut and hashed once a part.

Several models are fitted at once, each on the rows that aren't held out from
it: every round is one job, in which each task adds up the gradients of all
models and the blocks of slots are then summed by number.  Ten folds so cost
about as many jobs as one fit, and each row is read once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text
from quillmark.operators import model, predict
from quillmark.session import scratch

SLOTS = 2**17
#: Slots of a gradient that travel together.
BLOCK = 4096
#: Corrections that a model's search direction remembers.
MEMORY = 8
#: Words, or (slot, times), that are worked on together, but for a single row with more.
PART = 2**17
#: Rows of so many slots are filled with zeros for matrix products, this many numbers at once.
DENSE, FILLED = 2**13, 2**18
#: ``1 + ln times``
LOGS = 1 + np.log(np.maximum(np.arange(256), 1))
#: What ``_packed`` makes of a row's terms.
PACKED = "slot binary, times binary, more binary, head int"

#: row, slot and times of each slot of each row, in this order
Terms = tuple[np.ndarray, np.ndarray, np.ndarray]


def _said(body: Column, slots: int) -> list[Column]:
    """Slots of the words of a text and of their pairs, and all that stands between blanks."""
    said = F.coalesce(body, F.lit(""))
    words = F.transform(text.word_grams(said), lambda t: F.pmod(F.xxhash64(t), F.lit(slots)).cast("int"))
    return [words.alias("__words"), F.split(F.lower(said), r"[\s\p{Z}]+").alias("__chars")]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and how many each row has; null lists are empty."""
    return column.flatten().to_numpy(zero_copy_only=False), _sizes(column)


def _sizes(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in parts with at most ``most`` elements of a list column, or bytes of a binary one; a row stays whole."""
    held = batch[column]
    ends = np.cumsum(_sizes(held) if pa.types.is_list(held.type) or pa.types.is_large_list(held.type) else np.diff(_offsets(held)))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (most or PART), "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hashed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of pieces of ``data`` that are shorter than 32 bytes."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)).view("<u8")[:, 0]
    out = np.empty(len(start), np.uint64)
    for n in np.flatnonzero(np.bincount(length)):
        mine = np.flatnonzero(length == n)
        at, done = start[mine], 0
        h = np.full(len(at), 42 + int(p5) + int(n), np.uint64)
        while done + 8 <= n:
            h = _rotated(h ^ (_rotated(eight[at + done] * p2, 31) * p1), 27) * p1 + p4
            done += 8
        if done + 4 <= n:
            h = _rotated(h ^ ((eight[at + done] & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
            done += 4
        while done < n:
            h = _rotated(h ^ (data[at + done].astype(np.uint64) * p5), 11) * p1
            done += 1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[mine] = h ^ (h >> np.uint64(32))
    return out.view(np.int64)


def _gram_slots(words: list[str], slots: int, low: int = 2, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all sequences of ``low`` to ``high`` characters of each word with a blank at both ends, and how many each word has; an empty one has none."""
    data = np.frombuffer("".join(f" {w} " for w in words if w).encode(), np.uint8)
    lengths = np.array([len(w) + 2 if w else 0 for w in words], np.int64)
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(owner))  # characters up to the word's end
    owners, begins, sizes = [], [], []
    for n in range(low, high + 1):
        at = np.flatnonzero(left >= n)
        owners.append(owner[at])
        begins.append(first[at])
        sizes.append(first[at + n] - first[at])
    owner = np.concatenate(owners)
    found = _hashed(data, np.concatenate(begins), np.concatenate(sizes)) % slots
    return found[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def _summed_by(keys: np.ndarray, weights: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, in their order, and the sums of their weights."""
    if size <= 8 * len(keys):
        total = np.bincount(keys, weights, size)
        found = np.flatnonzero(total)
        return found, total[found]
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights, len(found))


def _counted(batch: pa.RecordBatch, slots: int) -> Terms:
    """The terms of each row out of ``_said``."""
    n, width = len(batch), 2 * slots
    slot, lengths = _lists(batch["__words"])
    keys, weights = [np.repeat(np.arange(n) * width, lengths) + slot], [np.ones(len(slot))]
    met = batch["__chars"].flatten().dictionary_encode()
    grams, each = _gram_slots(met.dictionary.to_pylist(), slots)
    words = max(1, len(each))
    pairs, times = _summed_by(np.repeat(np.arange(n) * words, _sizes(batch["__chars"])) + met.indices.to_numpy(), None, n * words)
    word = pairs % words
    size = each[word]
    place = np.repeat((np.cumsum(each) - each)[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    keys.append(np.repeat(pairs // words * width + slots, size) + grams[place])
    weights.append(np.repeat(times, size))
    found, times = _summed_by(np.concatenate(keys).astype(np.int64), np.concatenate(weights), n * width)
    return found // width, found % width, times.astype(np.int64)


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the rows of a binary column begin in its bytes, and where the last one ends."""
    large = pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]


def _bytes(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column without nulls, and how many each row has."""
    ends = _offsets(column).astype(np.int64)
    size = np.dtype(kind).itemsize
    held = column.buffers()[2]
    if held is None or ends[-1] == ends[0]:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    return np.frombuffer(held, np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // size


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _kind(slots: int):
    return np.uint16 if 2 * slots <= 2**16 else np.uint32


def _packed(terms: Terms, n: int, slots: int) -> list[pa.Array]:
    """The columns of PACKED; times from 255 on stand in ``more``."""
    row, slot, times = terms
    lengths, many = np.bincount(row, minlength=n), times >= 255
    head = np.bincount(row[slot < slots], minlength=n).astype(np.int32)
    return [_binary(slot.astype(_kind(slots)), lengths), _binary(np.minimum(times, 255).astype(np.uint8), lengths), _binary(times[many].astype(np.uint32), np.bincount(row[many], minlength=n)), pa.array(head)]


def _unpacked(batch: pa.RecordBatch, slots: int) -> Terms:
    """The terms of ``_packed``."""
    slot, lengths = _bytes(batch["slot"], _kind(slots))
    times = _bytes(batch["times"], np.uint8)[0].astype(np.int64)
    times[times == 255] = _bytes(batch["more"], np.uint32)[0]
    return np.repeat(np.arange(len(batch)), lengths), slot.astype(np.int64), times


def _weighted(row: np.ndarray, slot: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """``(1 + ln times) * idf``, each half of a row of unit length; slots without idf weigh nothing."""
    raw = (1 + np.log(times)) * idf[slot]
    half = 2 * row + (slot >= len(idf) // 2)
    length = np.sqrt(np.bincount(half, raw * raw, 2 * n))
    return raw / np.where(length > 0, length, 1)[half]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _margins(row: np.ndarray, slot: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Scores (rows, classes); the last column of ``weights`` holds the intercepts."""
    return np.stack([np.bincount(row, w[slot] * values, n) + w[-1] for w in weights], axis=1)


@dataclass(frozen=True)
class Lexical:
    """Labels, inverse document frequencies by slot and weights (label, slot, the intercept last)."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray

    @property
    def slots(self) -> int:
        return len(self.idf) // 2

    def scores(self, rows: DataFrame, key: str, body: Column, categories: list[str]) -> DataFrame:
        """``rows`` with ``lexical``: the probability of each category in this order, 0 for those that training never saw."""
        return scored(rows, [self], F.array(F.lit(0)), body, categories).withColumn("lexical", F.col("lexical")[0])


def scored(rows: DataFrame, models: list[Lexical], which: Column, body: Column, categories: list[str]) -> DataFrame:
    """``rows`` with ``lexical``: for each of the models that ``which`` (an array of numbers) asks, its probabilities in the order of the categories."""
    slots = models[0].slots
    asked = rows.select(*rows.columns, which.alias("__which"), *_said(body, slots))
    return _asked(asked, rows.schema.fields, models, categories, "__chars", lambda batch: _counted(batch, slots))


def _asked(asked: DataFrame, fields: list[T.StructField], models: list[Lexical], categories: list[str], size: str, read: Callable[[pa.RecordBatch], Terms]) -> DataFrame:
    """The columns ``fields`` and ``lexical``: what the models say that ``__which`` names, of the terms that ``read`` finds in a batch."""
    shared = asked.sparkSession.sparkContext.broadcast(models)
    order = [[m.labels.index(c) if c in m.labels else -1 for c in categories] for m in models]
    columns = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in (part for whole in batches for part in _parts(whole, size)):
            n = len(batch)
            asked, lengths = _lists(batch["__which"])
            owner = np.repeat(np.arange(n), lengths)
            out = np.zeros((len(asked), len(categories)))
            row, slot, times = read(batch)
            for k, m in enumerate(found):
                mine = np.flatnonzero(asked == k)
                if len(mine):
                    there = np.zeros(n, bool)
                    there[owner[mine]] = True
                    here = there[row]
                    values = _weighted(row[here], slot[here], times[here], m.idf, n)
                    p = _softmax(_margins(row[here], slot[here], values, m.weights, n))[owner[mine]]
                    out[mine] = np.column_stack([p, np.zeros(len(mine))])[:, order[k]]
            inner = pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1, dtype=np.int32) * len(categories)), pa.array(out.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), inner)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), lists], [*columns, "lexical"])

    return asked.mapInArrow(run, T.StructType([*fields, T.StructField("lexical", T.ArrayType(T.ArrayType(T.DoubleType())))]))


def prepared(rows: DataFrame, kept: list[Column], body: Column, slots: int) -> DataFrame:
    """Columns of the rows and the terms of a text (PACKED), written once."""
    fields = rows.select(*kept).schema.fields
    columns = [f.name for f in fields]
    asked = rows.select(*kept, *_said(body, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, "__chars")):
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *_packed(_counted(batch, slots), len(batch), slots)], [*columns, "slot", "times", "more", "head"])

    return _kept_as(asked.mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL(PACKED).fields])))


def _kept_as(terms: DataFrame) -> DataFrame:
    path = scratch(terms.sparkSession, "terms")
    terms.write.option("compression", "zstd").parquet(path)
    return terms.sparkSession.read.schema(terms.schema).parquet(path)


def _folded(terms: Terms, fine: int, slots: int) -> Terms:
    """Terms in ``fine`` slots as those in ``slots``, of which ``fine`` is a multiple."""
    if fine == slots or not len(terms[0]):
        return terms
    row, slot, times = terms
    keys = row * (2 * slots) + (slot >= fine) * slots + slot % fine % slots
    found, times = _summed_by(keys, times, (int(row[-1]) + 1) * 2 * slots)
    return found // (2 * slots), found % (2 * slots), times.astype(np.int64)


def _kept(held: pa.Array, n: int, models: int) -> np.ndarray:
    """(model, row): whether the row trains the model."""
    values, lengths = _lists(held)
    kept = np.ones((models, n), bool)
    kept[values, np.repeat(np.arange(n), lengths)] = False
    return kept


def _summed(blocks: DataFrame) -> dict[int, np.ndarray]:
    """Blocks (block, v) added up by number, in the tasks first."""
    total = blocks.groupBy("block").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("block", vector_to_array("v").alias("v"))
    return {b: np.array(v) for b, v in zip(*(c.to_pylist() for c in total.toArrow().columns), strict=True)}


def _in_blocks(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(0, len(values), BLOCK):
        part = values[k : k + BLOCK]
        if part.any():
            yield k // BLOCK, np.pad(part, (0, BLOCK - len(part)))


def _whole(blocks: dict[int, np.ndarray], size: int) -> np.ndarray:
    out = np.zeros(-(-size // BLOCK) * BLOCK)
    for k, v in blocks.items():
        out[k * BLOCK : (k + 1) * BLOCK] = v
    return out[:size]


def _reduced(terms: DataFrame, size: int, add) -> np.ndarray:
    """``add(total, batch)`` over all rows, where ``total`` has ``size`` numbers; one job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in (part for whole in batches for part in _parts(whole, "slot")):
            add(total, batch)
        found = list(_in_blocks(total))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["block", "v"])

    return _whole(_summed(terms.mapInArrow(run, "block int, v array<double>")), size)


class _Search:
    """One model's quasi-Newton search: a point, a direction, and what is known of the curvature."""

    def __init__(self, size: int):
        self.x, self.step, self.done = np.zeros(size), 1.0, False
        self.loss = self.gradient = self.direction = None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def trial(self) -> np.ndarray:
        return self.x if self.direction is None else self.x + self.step * self.direction

    def _turn(self) -> None:
        q, alphas = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            alphas.append((s @ q) / (y @ s))
            q -= alphas[-1] * y
        q *= (self.pairs[-1][0] @ self.pairs[-1][1]) / (self.pairs[-1][1] @ self.pairs[-1][1]) if self.pairs else 1 / max(1.0, np.linalg.norm(q))
        for (s, y), alpha in zip(self.pairs, reversed(alphas), strict=True):
            q += s * (alpha - (y @ q) / (y @ s))
        self.direction, self.step = -q, 1.0

    def learn(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        """Takes what the trial point has: a step, or a shorter trial."""
        if self.direction is None:
            self.loss, self.gradient = loss, gradient
            self._turn()
            return
        if loss > self.loss + 1e-4 * self.step * (self.gradient @ self.direction):
            self.step *= 0.4
            self.done = self.step < 1e-8
            return
        s, y = self.step * self.direction, gradient - self.gradient
        if y @ s > 1e-12:
            self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.done = abs(self.loss - loss) <= tolerance * max(1.0, abs(loss))
        self.x, self.loss, self.gradient = self.x + s, loss, gradient
        self._turn()


def fit_all(rows: DataFrame, body: Column, label: str, held: Column, models: int, slots: int = SLOTS, c: float = 8.0, rounds: int = 200, tolerance: float = 1e-6) -> list[Lexical]:
    """Models of the rows with a label, each without the rows that ``held``, an array of model numbers, keeps from it.

    Each minimises ``c * sum(weight * cross entropy) + |weights|**2 / 2`` with
    classes weighted alike; frequencies of terms are those of its own rows.  The
    driver holds every model: ``models * labels * 2 * slots`` numbers.
    """
    known = rows.where(F.col(label).isNotNull())
    terms = prepared(known, [F.col(label).alias("label"), held.cast("array<int>").alias("held")], body, slots)
    return fit_terms(terms, "label", F.col("held"), models, slots, slots, c, rounds, tolerance)


def _ready(terms: DataFrame, models: int, fine: int, slots: int, idf: np.ndarray) -> DataFrame:
    """own, held, the terms in ``slots`` and ``norm``: for each model the lengths of both halves of a row, written once."""
    shared = terms.sparkSession.sparkContext.broadcast(idf * idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, "slot", 4 * PART)):
            n = len(batch)
            row, slot, times = found = _folded(_unpacked(batch, fine), fine, slots)
            raw, half = (1 + np.log(times)) ** 2, 2 * row + (slot >= slots)
            length = np.sqrt(np.stack([np.bincount(half, raw * squared[slot], 2 * n) for squared in shared.value], axis=1))  # (half row, model)
            norm = np.where(length > 0, length, 1).reshape(n, 2 * models)
            yield pa.RecordBatch.from_arrays([batch["own"], batch["held"], *_packed(found, n, slots), _binary(norm.ravel(), np.full(n, 2 * models))], ["own", "held", "slot", "times", "more", "head", "norm"])

    return _kept_as(terms.mapInArrow(run, f"own int, held array<int>, {PACKED}, norm binary"))


def _products(batch: pa.RecordBatch, slots: int, room: np.ndarray) -> tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """``1 + ln times`` of a part as a matrix: its halves times (2 * slots, columns), giving (row, half, column), and back, from that to (2 * slots, columns)."""
    slot, lengths = _bytes(batch["slot"], _kind(slots))
    times, more = _bytes(batch["times"], np.uint8)[0], _bytes(batch["more"], np.uint32)[0]
    values = LOGS[times]
    if len(more):
        values[times == 255] = 1 + np.log(more)
    n, width, slot = len(batch), 2 * slots, slot.astype(np.int64)
    if n * width <= len(room):
        filled = room[: n * width]
        filled[:] = 0
        filled[np.repeat(np.arange(n) * width, lengths) + slot] = values
        parts = [filled.reshape(n, 2, slots)[:, h] for h in (0, 1)]

        def forth(weights: np.ndarray) -> np.ndarray:
            return np.stack([parts[0] @ weights[:slots], parts[1] @ weights[slots:]], axis=1)

        def back(rest: np.ndarray) -> np.ndarray:
            return np.concatenate([parts[0].T @ rest[:, 0], parts[1].T @ rest[:, 1]])

        return forth, back

    head = batch["head"].to_numpy()
    sizes = np.stack([head, lengths - head], axis=1).ravel()
    there = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[there]

    def forth(weights: np.ndarray) -> np.ndarray:
        out = np.zeros((2 * n, weights.shape[1]))
        for j in range(weights.shape[1] if len(there) else 0):
            out[there, j] = np.add.reduceat(values * np.ascontiguousarray(weights[:, j])[slot], begins)
        return out.reshape(n, 2, -1)

    def back(rest: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(slot, values * np.repeat(r, sizes), width) for r in rest.reshape(2 * n, -1).T], axis=1)

    return forth, back


def fit_terms(terms: DataFrame, label: str, held: Column, models: int, fine: int, slots: int, c: float = 8.0, rounds: int = 200, tolerance: float = 1e-6) -> list[Lexical]:
    """``fit_all`` on what ``prepared`` wrote with ``fine`` slots, a multiple of ``slots``."""
    if fine % slots:
        raise ValueError(f"{fine} is no multiple of {slots}")
    labels = sorted(r[0] for r in terms.where(F.col(label).isNotNull()).select(label).distinct().collect())  # one row for each category
    k, width = len(labels), 2 * slots
    if not k:
        raise ValueError("no row has a label")
    number = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    known = terms.where(F.col(label).isNotNull()).select(number.cast("int").alias("own"), held.cast("array<int>").alias("held"), "slot", "times", "more", "head")
    context = terms.sparkSession.sparkContext

    def count(total: np.ndarray, batch: pa.RecordBatch) -> None:
        kept = _kept(batch["held"], len(batch), models)
        row, slot, _ = _folded(_unpacked(batch, fine), fine, slots)
        own = batch["own"].to_numpy()
        for m in range(models):
            at = m * (width + k)
            total[at : at + width] += np.bincount(slot[kept[m][row]], minlength=width)
            total[at + width : at + width + k] += np.bincount(own[kept[m]], minlength=k)

    counts = _reduced(known, models * (width + k), count).reshape(models, width + k)
    held_df, per_class = counts[:, :width], counts[:, width:]
    n = per_class.sum(axis=1)
    idf = np.where(held_df > 0, np.log((1 + n[:, None]) / (1 + held_df)) + 1, 0.0)
    balance = np.where(per_class > 0, n[:, None] / (np.maximum(1, (per_class > 0).sum(axis=1))[:, None] * np.maximum(per_class, 1)), 0.0)
    size = k * (width + 1)
    searches = [_Search(size) for _ in range(models)]
    for search, classes in zip(searches, per_class, strict=True):
        # a class that a model never sees has no part in it
        search.absent = classes == 0
    ready = _ready(known, models, fine, slots, idf)
    rows_at_once = FILLED // width if width <= DENSE else 2**62
    for _ in range(rounds if k > 1 else 0):  # a single class is certain
        active = [m for m, s in enumerate(searches) if not s.done]
        if not active:
            break
        points = {m: searches[m].trial().reshape(k, width + 1) for m in active}
        # a shift of all classes changes no probability, and their slopes add up to zero: the last class follows from the others
        apart = np.stack([points[m][:-1] - points[m][-1] for m in active])  # (model, class, slot)
        weights = (apart[:, :, :-1] * idf[active][:, None, :]).reshape(-1, width).T
        shared = context.broadcast((np.ascontiguousarray(weights), apart[:, :, -1], balance[active], np.stack([searches[m].absent for m in active])))

        def slope(total: np.ndarray, whole: pa.RecordBatch, active=active, shared=shared, room=[]) -> None:  # noqa: B006
            weights, intercepts, balance, absent = shared.value
            total = total.reshape(len(active), -1)
            if not room:  # once in a task
                room.append(np.zeros(FILLED if width <= DENSE else 0))
            for at in range(0, len(whole), rows_at_once):
                batch = whole.slice(at, rows_at_once)
                rows = len(batch)
                kept = _kept(batch["held"], rows, models)[active]
                own = batch["own"].to_numpy()
                norm = _bytes(batch["norm"], np.float64)[0].reshape(rows, 2, models)[:, :, active]
                forth, back = _products(batch, slots, room[0])
                sums = forth(weights).reshape(rows, 2, len(active), k - 1) / norm[:, :, :, None]
                z = np.concatenate([sums.sum(axis=1) + intercepts, np.zeros((rows, len(active), 1))], axis=2)  # (row, model, class)
                z[:, absent] = -np.inf
                p = _softmax(z)
                w = np.where(kept.T, balance[:, own].T, 0.0)  # (row, model)
                mine = p[np.arange(rows), :, own]
                total[:, -1] -= np.where(w > 0, w * np.log(np.maximum(mine, 1e-300)), 0.0).sum(axis=0)
                p[np.arange(rows), :, own] -= 1
                p *= w[:, :, None]
                rest = p[:, None, :, :-1] / norm[:, :, :, None]
                total[:, : (k - 1) * width] += back(rest.reshape(rows, 2, -1)).T.reshape(len(active), -1)
                total[:, (k - 1) * width : -1] += p[:, :, :-1].sum(axis=0)

        sums = _reduced(ready, len(active) * ((k - 1) * (width + 1) + 1), slope).reshape(len(active), -1)
        shared.destroy()
        for place, m in enumerate(active):
            others = np.column_stack([sums[place, : (k - 1) * width].reshape(k - 1, width) * idf[m], sums[place, (k - 1) * width : -1]])
            slopes = np.concatenate([others, -others.sum(axis=0, keepdims=True)])
            slopes[searches[m].absent] = 0
            point = points[m].copy()
            point[:, -1] = 0  # intercepts aren't penalised
            searches[m].learn(c * sums[place, -1] + 0.5 * float((point * point).sum()), c * slopes.ravel() + point.ravel(), tolerance)
    fitted = []
    for m, search in enumerate(searches):
        weights = search.x.reshape(k, width + 1)[~search.absent]
        fitted.append(Lexical([x for x, gone in zip(labels, search.absent, strict=True) if not gone], idf[m], weights))
    return fitted


def fit(rows: DataFrame, key: str, body: Column, label: str, slots: int = SLOTS, c: float = 8.0, rounds: int = 200) -> Lexical:
    """The model of ``rows`` with a text and a label; rows without a label are left out."""
    return fit_all(rows, body, label, F.array().cast("array<int>"), 1, slots, c, rounds)[0]


def cross_validated(ads: DataFrame, key: str, group: str, lexicon: dict[str, list[str]], networks: list[str], folds: int = 5, slots: int = SLOTS, rounds: int = 200, digits: int = 9, keep: list[str] | None = None) -> DataFrame:
    """Each ad (key, title, description, advertiser, domain, actual) with answers of models that never saw its fold.

    ``known`` false: whole groups are held out, and there is no memory; true:
    single ads are, and advertisers are remembered from the other folds.  All
    models are fitted together, and each ad is read once for both.  ``keep``
    names the columns of the ads that are returned, all by default.
    """
    return answers_of_folds(dealt(ads, key, group, lexicon, networks, folds, slots, keep), ads.columns if keep is None else keep, lexicon, folds, slots, slots, rounds, digits)


def dealt(ads: DataFrame, key: str, group: str, lexicon: dict[str, list[str]], networks: list[str], folds: int, slots: int, keep: list[str] | None = None) -> DataFrame:
    """The ads with an actual category as ``prepared`` terms in so many slots, with their folds and what an answer takes from their text."""
    body = text.build_text(*map(F.col, ("title", "description", "advertiser", "domain")))
    apart, mixed = (F.coalesce(model.fold(F.col(c).cast("string"), folds), F.lit(0)) for c in (group, key))
    read = predict.read(ads.where(F.col("actual").isNotNull()), lexicon)
    own = [F.col(c) for c in (ads.columns if keep is None else keep)]
    more = [F.col("actual").alias("__actual"), F.array(apart, mixed + folds).alias("__held"), mixed.alias("__mixed"), text.advertiser_key(F.col("domain"), F.col("advertiser"), networks).alias("memory_key"), F.col("said"), F.col("hits")]
    return prepared(read, [*own, *more], body, slots)


def answers_of_folds(terms: DataFrame, keep: list[str], lexicon: dict[str, list[str]], folds: int, fine: int, slots: int, rounds: int, digits: int = 9) -> DataFrame:
    """``cross_validated`` on what ``dealt`` wrote in ``fine`` slots, a multiple of ``slots``."""
    categories = list(lexicon)
    models = fit_terms(terms, "__actual", F.col("__held"), 2 * folds, fine, slots, rounds=rounds)
    fields = [f for f in terms.schema.fields if f.name in {*keep, "__mixed", "memory_key", "said", "hits"}]
    asked = terms.select(*[f.name for f in fields], F.col("__held").alias("__which"), "slot", "times", "more", "head")
    both = _asked(asked, fields, models, categories, "slot", lambda batch: _folded(_unpacked(batch, fine), fine, slots))
    each = both.select(*[f.name for f in fields], F.lit(None).cast("array<double>").alias("semantic"), F.posexplode("lexical").alias("scheme", "lexical"))
    # what other folds know of an advertiser: all of it less its own fold's part
    sums = lambda keys: terms.where(F.col("__actual").isin(*categories)).groupBy(*keys).agg(F.array(*[F.count_if(F.col("__actual") == c).cast("double") for c in categories]).alias("n"))
    own, whole = sums(["memory_key", "__mixed"]).withColumnRenamed("n", "own"), sums(["memory_key"])
    less = F.zip_with("n", F.coalesce("own", F.array_repeat(F.lit(0.0), len(categories))), lambda a, b: a - b)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    known = each.join(whole, "memory_key", "left").join(own, ["memory_key", "__mixed"], "left").withColumn("less", less)
    remembered = F.when((F.col("scheme") == 1) & (total(F.col("less")) > 0), F.transform("less", lambda x: x / total(F.col("less"))))
    told = predict.answered(known.withColumn("remembered", remembered), lexicon, digits=digits)
    return told.select(*keep, "answer.*", (F.col("scheme") == 1).alias("known"))


def validation_report(answers: DataFrame) -> DataFrame:
    """One row, from answers read three times (persist them): accuracy and macro F1 with groups held out, and the accuracy for known groups."""
    apart = predict.accuracy_and_f1(answers.where("not known"), "actual", "category")
    mixed = answers.where("known").agg(F.round(F.avg((F.col("actual") == F.col("category")).cast("double")), 3).alias("known_accuracy"))
    return apart.crossJoin(F.broadcast(mixed))  # one row each
