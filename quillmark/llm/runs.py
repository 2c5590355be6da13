"""Periodic runs of words, found in a suffix tree by the method of Stoye and Gusfield.

A run is a stretch of words with smallest period q that repeats at least
``least_exponent`` times and that no neighbouring word extends.

1. Every word of such a stretch occurs ``least_exponent`` times in it, so a text
   is cut at words that are rarer, again and again until no stretch changes.
   Nothing that belongs to a run is lost; ordinary prose leaves nothing.
2. A suffix tree of the stretches is built: suffix array by doubling, common
   prefixes, and the intervals of the latter, which are the tree's inner nodes.
3. At each node of depth D the leaf lists of all children but the largest are
   walked (n log n leaves in all).  A leaf i whose partner at i + D or i - D is a
   leaf of the node too starts a tandem repeat; it is branching if the words
   behind its halves differ.
4. Branching repeats are rotated to the left as far as they go.  That gives the
   run with the same end; repeats of a multiple of its period are merged into it.

Texts lie where they are; nothing is shuffled.  A task holds one text's tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import release, small

#: Words are what lies between these; ``bytes.split`` parts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: Leaves looked at together.
LEAVES = 1 << 20


def stretches(codes: np.ndarray, least_length: int, occurrences: int) -> np.ndarray:
    """Positions that may belong to a run, in ascending order."""
    at = np.flatnonzero(np.bincount(codes)[codes] >= occurrences) if len(codes) else np.empty(0, np.int64)
    while len(at):
        stretch = np.cumsum(np.diff(at, prepend=-2) > 1) - 1
        long = np.bincount(stretch)[stretch] >= least_length
        if not long.all():
            at = at[long]
            continue
        _, group, n = np.unique(stretch * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        often = n[group] >= occurrences
        if often.all():
            break
        at = at[often]
    return at


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the rank of each, and the common prefix of each with the one before (0 for the first)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1]
    levels, width = [], 1
    while True:
        levels.append(rank.astype(np.int32))
        if rank.max() == n - 1:
            break
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    open_ = np.arange(1, n)
    for level in range(len(levels) - 2, -1, -1):
        a, b = order[open_ - 1] + common[open_], order[open_] + common[open_]
        inside = (a < n) & (b < n)
        same = np.zeros(len(open_), bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        # equal ranks at the text's end stand for shorter suffixes, which are never equal
        common[open_[same]] += 1 << level
    return order, rank, common


def inner_nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(split, first leaf, behind the last leaf) for each place where two children of an inner node meet."""
    n = len(common)
    values = common.tolist()
    first, behind = [0] * n, [n] * n
    stack: list[int] = []
    for i in range(1, n):
        value = values[i]
        while stack and values[stack[-1]] > value:
            behind[stack.pop()] = i
        first[i] = (first[stack[-1]] if values[stack[-1]] == value else stack[-1]) if stack else 0
        stack.append(i)
    split = np.flatnonzero(common > 0)
    return split, np.array(first)[split], np.array(behind)[split]


def small_children(split: np.ndarray, first: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index into ``split`` that stands for the node, first leaf, behind the last leaf) of every child but the largest."""
    order = np.lexsort((split, behind, first))
    s, f, b = split[order], first[order], behind[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (b[1:] != b[:-1])])
    last = np.concatenate([new[1:], [True]])
    node = np.cumsum(new) - 1
    begin = np.where(new, f, np.concatenate([[0], s[:-1]]))
    nodes = np.concatenate([node, node[last]])
    begins, ends = np.concatenate([begin, s[last]]), np.concatenate([s, b[last]])
    by_size = np.lexsort((begins, begins - ends, nodes))
    largest = np.concatenate([[True], np.diff(nodes[by_size]) > 0])
    rest = by_size[~largest]
    return order[new][nodes[rest]], begins[rest], ends[rest]


def branching_repeats(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat; words that are negative equal none."""
    n = len(text)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order, rank, common = suffix_array(text)
    split, first, behind = inner_nodes(common)
    if not len(split):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    node, begin, end = small_children(split, first, behind)
    ends = np.cumsum(end - begin)
    found = []
    at = 0
    while at < len(node):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAVES, "right")))
        width = (end - begin)[at:stop]
        v = np.repeat(node[at:stop], width)
        leaf = order[np.arange(width.sum()) + np.repeat(begin[at:stop] - (np.cumsum(width) - width), width)]
        depth, low, high = common[split[v]], first[v], behind[v]
        for start in (leaf, leaf - depth):  # the leaf as first half, and as second
            other = start + depth if start is leaf else start
            inside = (other >= 0) & (other < n)
            place = rank[np.where(inside, other, 0)]
            inside &= (place >= low) & (place < high)
            i, d = start[inside], depth[inside]
            after = i + 2 * d
            differs = np.ones(len(i), bool)
            has = after < n
            differs[has] = text[after[has]] != text[i[has]]
            found.append(np.stack([i[differs], d[differs]]))
        at = stop
    both = np.concatenate(found, axis=1)
    both = np.unique(both, axis=1)
    return both[0], both[1]


def rotations(text: np.ndarray, start: int, period: int) -> int:
    """By how many words the repeat can be rotated to the left."""
    done, step = 0, 64
    while True:
        low = max(0, start - done - step)
        differ = np.flatnonzero(text[low : start - done] != text[low + period : start - done + period])
        if len(differ):
            return done + start - done - low - 1 - int(differ[-1])
        done = start - low
        if not low:
            return done
        step *= 2


def runs_of(text: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``text``, whose separators are negative and distinct."""
    start, period = branching_repeats(text)
    more = np.maximum(least_length, least_exponent * period) - 2 * period  # words that rotation must add
    able = (more <= start) & ((more <= 0) | ((text[start - 1] == text[start - 1 + period]) & (text[np.maximum(start - more, 0)] == text[np.maximum(start - more, 0) + period])))
    start, period = start[able], period[able]
    by_end = np.lexsort((period, start + 2 * period))
    found: list[tuple[int, int, int]] = []
    here: list[tuple[int, int]] = []
    last = -1
    for i, d in zip(start[by_end].tolist(), period[by_end].tolist(), strict=True):
        end = i + 2 * d
        if end != last:
            here, last = [], end
        if any(i >= s and d % q == 0 for s, q in here):
            continue
        s = i - rotations(text, i, d)
        here.append((s, d))
        if end - s >= max(least_length, least_exponent * d):
            found.append((s, end - s, d))
    return found


def runs_of_words(words: list, least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    seen: dict = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    at = stretches(codes, least_length, least_exponent)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    text = np.insert(codes[at], breaks, -1 - np.arange(len(breaks)))
    places = np.insert(at, breaks, 0)
    return sorted(((int(places[s]), n, q) for s, n, q in runs_of(text, least_length, least_exponent)), key=lambda r: (r[0], r[2]))


def find(docs: DataFrame, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed, the text without repetitions.

    A word goes if a run holds it behind the run's first period; the others are
    joined by single blanks.  Null, empty and blank texts have no words, no runs
    and an empty ``collapsed``.  Equal texts give equal runs; repeated rows stay.
    Further columns are ignored; no rows give no rows.
    """
    if least_length < 2 or least_exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, found, texts = [], [], []
            for text in batch["text"]:
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                runs = runs_of_words(words, least_length, least_exponent) if len(words) >= least_length else []
                kept = words
                if runs:
                    drop = np.zeros(len(words), bool)
                    for s, n, q in runs:
                        drop[s + q : s + n] = True
                    kept = [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def with_cycles(text: Column, doc_id: Column) -> Column:
    """The texts of the query: a tenth of them, by the checksum of the id, repeat a stretch of theirs from some word on."""
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def cycled(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: w[(a + (i - a) % p).cast("int")])
        return F.concat_ws(" ", F.slice(w, F.lit(1), a.cast("int")), tail)

    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, cycled(w)).otherwise(text))[0]
    return F.when(text.isNotNull() & (h % 10 == 0), bound).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest (then first, then shortest period) run, and checksums of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(spelled, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
