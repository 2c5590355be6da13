"""Alignment of the tokens that two tokenizers make of one text.

Tokenizer A is a byte-level BPE and reads a space and the text; tokenizer B is a
SentencePiece model, which adds that space itself.  Both cover the same bytes,
so the union of both arrays of end offsets cuts a text into elementary
intervals: each has one owner in A and one in B (found by ``searchsorted``) and
is one link.  An end that both have closes a group.

Neither tokenizer joins bytes across a single space or line break between two
visible characters and what is before it, so texts are cut there and each part
is aligned once: parts recur, and most come from a memory of bounded size.  All
new parts of a batch are aligned at once, as if they were one text.

How often a pair of ids is linked in the whole corpus is counted by grouping.
Pairs with a large share of all links (at most ``hot_pairs``, since no more can
have that share) are looked up where the text lies; the others are joined.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import release, small
from quillmark.llm.store import materialize

#: The memory of parts starts anew beyond this size; a part counts as its characters and this many bytes.
MEMORY_BYTES, PART_BYTES = 100_000_000, 320
#: At most so many pairs are looked up in place.
HOT_PAIRS = 1 << 18
CUT, CUT_BLANKS = re.compile(r"(?<=\S)(?=[ \n]\S)"), re.compile(r"(?<=\S)(?= \S)")
#: Blanks that aren't single ones between visible characters.
UNEVEN = ("  ", " \n", "\n ", "\n\n", "\0")
#: White space other than spaces and line breaks.
ODD_SPACE = re.compile(r"[^\S \n]")
#: A single space or line break, then visible characters at both ends.
EVEN = re.compile(r"[ \n]\S(?:[^\0]*\S)?\Z")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

_loaded: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """Ids of both tokenizers, and the bytes of each id."""

    def __init__(self, ranks: str, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            by_bytes = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        self.a_bytes = [b""] * (max(by_bytes.values()) + 1)
        for token, rank in by_bytes.items():
            self.a_bytes[rank] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])

        #: Whether line breaks are tokens of their own in B, as they are in A.
        self.lines_apart = not any("\n" in p for p in pieces)

    def parts(self, text: str) -> list[str]:
        """A space and the text, cut before single spaces and line breaks between visible characters."""
        spaced = " " + text
        if not self.lines_apart:
            return CUT_BLANKS.split(spaced)
        if text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, UNEVEN)) or ODD_SPACE.search(text):
            return CUT.split(spaced)
        return spaced.replace(" ", "\0 ").replace("\n", "\0\n")[1:].split("\0")

    def ids(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both tokenizers' ids of each part."""
        return list(map(self.a.encode_ordinary, parts)), self.b_ids(parts)

    def b_ids(self, parts: list[str]) -> list[list[int]]:
        """B's ids of each part.  B adds a space: where a part has none, its token goes."""
        b = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [x if p[0] == " " else x[1:] for p, x in zip(parts, b, strict=True)]

    def checked(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """A's ids of all parts, B's, where each part ends in both and in bytes, and whether both spell it; parts that aren't spelled have none.

        Parts between which neither tokenizer joins bytes are given to A as one
        text; if its tokens don't spell each part, all are encoded one by one.
        """
        wanted = [p.encode() for p in parts]
        sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
        bounds = np.cumsum(sizes)
        b_lists = self.b_ids(parts)
        if len(parts) > 1 and all(map(EVEN.match, parts)):
            a = np.array(self.a.encode_ordinary("".join(parts)), np.int64)
            b = np.fromiter(chain.from_iterable(b_lists), np.int64)
            b_bounds = np.cumsum(np.fromiter(map(len, b_lists), np.int64, len(b_lists)))
            a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
            a_bounds = np.searchsorted(a_ends, bounds, "right")
            if (b_bounds > 0).all() and (a_bounds > 0).all() and (a_ends[a_bounds - 1] == bounds).all() and (b_ends[b_bounds - 1] == bounds).all():
                whole = b"".join(wanted)
                if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == whole == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
                    return a, b, a_bounds, b_bounds, bounds, np.ones(len(parts), bool)
        a_lists = list(map(self.a.encode_ordinary, parts))
        spell = lambda lists, of: [b"".join(map(of.__getitem__, x)) for x in lists]
        intact = np.array([x == w == y for w, x, y in zip(wanted, spell(a_lists, self.a_bytes), spell(b_lists, self.b_bytes), strict=True)], bool)
        if not intact.all():
            a_lists = [x if ok else [] for x, ok in zip(a_lists, intact, strict=True)]
            b_lists = [x if ok else [] for x, ok in zip(b_lists, intact, strict=True)]
        a = np.fromiter(chain.from_iterable(a_lists), np.int64)
        b = np.fromiter(chain.from_iterable(b_lists), np.int64)
        a_bounds = np.cumsum([len(x) for x in a_lists], dtype=np.int64)
        b_bounds = np.cumsum([len(x) for x in b_lists], dtype=np.int64)
        return a, b, a_bounds, b_bounds, np.cumsum(np.where(intact, sizes, 0)), intact


def tokenizers(ranks: str | None = None, model: str | None = None) -> Tokenizers:
    """Both tokenizers, loaded once in each Python worker."""
    import public_tokenizers

    key = (ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), model or public_tokenizers.path("piece_bpe_32k.model"))
    if key not in _loaded:
        _loaded[key] = Tokenizers(*key)
    return _loaded[key]


@dataclass
class Overlaps:
    """Elementary intervals of two arrays of ends: their owners, and how many tokens each group has had when it closes."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray
    group_ends: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> Overlaps:
    """One link for each elementary interval; tokens without bytes own none."""
    ends = np.union1d(a_ends, b_ends)
    ends = ends[ends > 0]
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    shared = ends[(a_ends[np.minimum(a, len(a_ends) - 1)] == ends) & (b_ends[np.minimum(b, len(b_ends) - 1)] == ends)] if len(ends) else ends
    return Overlaps(a, b, ends, shared, np.searchsorted(a_ends, shared, "right"), np.searchsorted(b_ends, shared, "right"))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``values`` one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[np.arange(total) + shift]


class Column:
    """Slices of growing arrays, by part; room is doubled when it runs out."""

    def __init__(self, kind):
        self.room, self.at = np.empty(1024, kind), np.empty((2, 1024), np.int64)
        self.used = self.parts = 0

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.used]

    @property
    def starts(self) -> np.ndarray:
        return self.at[0, : self.parts]

    @property
    def lengths(self) -> np.ndarray:
        return self.at[1, : self.parts]

    def add(self, values: np.ndarray, bounds: np.ndarray) -> None:
        """New slices: ``bounds`` are their ends in ``values``."""
        used, parts = self.used + len(values), self.parts + len(bounds)
        if used > len(self.room):
            self.room = np.concatenate([self.values, np.empty(2 * used - self.used, self.room.dtype)])
        if parts > self.at.shape[1]:
            self.at = np.concatenate([self.at[:, : self.parts], np.empty((2, 2 * parts - self.parts), np.int64)], axis=1)
        lengths = np.diff(bounds, prepend=0)
        self.room[self.used : used] = values
        self.at[0, self.parts : parts] = self.used + bounds - lengths
        self.at[1, self.parts : parts] = lengths
        self.used, self.parts = used, parts

    def take(self, parts: np.ndarray) -> np.ndarray:
        return ragged(self.values, self.starts[parts], self.lengths[parts])

    def before(self, parts: np.ndarray, other: "Column") -> np.ndarray:
        """For each value of ``other`` how many values here belong to earlier ones of the parts."""
        return np.repeat(np.cumsum(self.lengths[parts]) - self.lengths[parts], other.lengths[parts])


class Aligner:
    """Parts and what is known of them."""

    def __init__(self, both: Tokenizers, spelled: bool):
        self.both, self.spelled = both, spelled
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.intact = np.empty(0, bool)
        self.a, self.b, self.pairs = Column(np.int32), Column(np.int32), Column(np.int64)
        self.link_a, self.link_b, self.group_a, self.group_b = (Column(np.int32) for _ in range(4))
        self.groups: list[str] = []

    def full(self) -> bool:
        return self.size > MEMORY_BYTES

    def learn(self, parts: list[str]) -> np.ndarray:
        """Aligns parts that aren't known, all as one text, and returns the numbers they get."""
        both = self.both
        a, b, a_bounds, b_bounds, bounds, intact = both.checked(parts)
        found = overlaps(np.cumsum(both.a_length[a]), np.cumsum(both.b_length[b]))
        link_bounds = np.searchsorted(found.ends, bounds, "right")
        group_bounds = np.searchsorted(found.group_ends, bounds, "right")
        a_starts, b_starts = a_bounds - np.diff(a_bounds, prepend=0), b_bounds - np.diff(b_bounds, prepend=0)
        owner = np.repeat(np.arange(len(parts)), np.diff(link_bounds, prepend=0))
        self.a.add(a, a_bounds)
        self.b.add(b, b_bounds)
        self.pairs.add((a[found.a] << 32) | b[found.b], link_bounds)
        self.link_a.add(found.a - a_starts[owner], link_bounds)
        self.link_b.add(found.b - b_starts[owner], link_bounds)
        self.group_a.add(np.diff(found.group_a, prepend=0), group_bounds)
        self.group_b.add(np.diff(found.group_b, prepend=0), group_bounds)
        first = len(self.intact)
        self.intact = np.concatenate([self.intact, intact])
        if self.spelled:
            a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
            groups, x, y = [], 0, 0
            for i, j in zip(found.group_a.tolist(), found.group_b.tolist(), strict=True):
                groups.append(f"{a_text[x]}|{b_text[y]}" if i == x + 1 and j == y + 1 else ",".join(a_text[x:i]) + "|" + ",".join(b_text[y:j]))
                x, y = i, j
            at = 0
            for end in group_bounds.tolist():
                self.groups.append(";".join(groups[at:end]))
                at = end
        self.size += sum(map(len, parts)) + PART_BYTES * len(parts)
        return np.arange(first, first + len(parts))

    def read(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The parts of each text by number; None where it has no tokens."""
        cut = [self.both.parts(t) if t else [] for t in texts]
        new: tuple[list[str], list[str]] = ([], [])
        for part in sorted(set(chain.from_iterable(cut)).difference(self.known)):
            new[EVEN.match(part) is None].append(part)
        for parts in filter(None, new):
            self.known.update(zip(parts, self.learn(parts).tolist(), strict=True))
        found: list[np.ndarray | None] = []
        for text, parts in zip(texts, cut, strict=True):
            numbers = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            if not self.intact[numbers].all():  # the whole text decides
                numbers = self.learn([" " + text])
            found.append(numbers if len(parts) and self.intact[numbers].all() else None)
        return found


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, ranks: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, group_a and group_b (tokens of each group), link_a and link_b (token numbers of each link).

    Null and empty texts, and texts whose tokens don't spell a space and the
    text, have empty arrays.  Equal texts are aligned alike; repeated rows stay.
    Further columns are ignored; no rows give no rows.
    """
    names = ["a_ids", "b_ids", "group_a", "group_b", "link_a", "link_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligner(tokenizers(ranks, model), False)
        for batch in small(batches):
            if known.full():
                known.forget()
            found = known.read(batch["text"].to_pylist())
            found = [np.empty(0, np.int64) if x is None else x for x in found]
            lists = [[c.take(x) for x in found] for c in (known.a, known.b, known.group_a, known.group_b)]
            lists += [[links.take(x) + tokens.before(x, links) for x in found] for tokens, links in ((known.a, known.link_a), (known.b, known.link_b))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.list_(pa.int32())) for x in lists)], ["doc_id", *names])

    return _texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} array<int>" for n in names))


def group_products(aligned: DataFrame) -> DataFrame:
    """doc_id, group_number, a_id, b_id: every A token of a group with every B token of it."""
    running = lambda c: F.expr(f"transform({c}, (x, i) -> aggregate(slice({c}, 1, i), 0, (s, y) -> s + y))")
    groups = aligned.withColumn("sa", running("group_a")).withColumn("sb", running("group_b"))
    each = groups.select("doc_id", "a_ids", "b_ids", F.posexplode(F.arrays_zip("sa", "group_a", "sb", "group_b")).alias("group_number", "g"))
    sides = each.select("doc_id", "group_number", F.expr("slice(a_ids, g.sa + 1, g.group_a)").alias("a"), F.expr("slice(b_ids, g.sb + 1, g.group_b)").alias("b"))
    return sides.select("doc_id", "group_number", F.explode("a").alias("a_id"), "b").select("doc_id", "group_number", "a_id", F.explode("b").alias("b_id"))


def pair_counts(docs: DataFrame, ranks: str | None = None, model: str | None = None) -> DataFrame:
    """pair (A's id in the upper 32 bits, B's in the lower), n: how many links of the corpus hold it; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligner(tokenizers(ranks, model), False)
        times = np.zeros(0, np.int64)

        def summed() -> pa.RecordBatch:
            n = np.zeros(len(known.intact), np.int64)
            n[: len(times)] = times
            pairs, at = np.unique(known.pairs.values, return_inverse=True)
            total = np.bincount(at, np.repeat(n, known.pairs.lengths), len(pairs)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[total > 0]), pa.array(total[total > 0])], ["pair", "n"])

        for batch in small(batches):
            if known.full():
                yield summed()
                known.forget()
                times = np.zeros(0, np.int64)
            found = [x for x in known.read(batch["text"].to_pylist()) if x is not None]
            if found:
                now = np.bincount(np.concatenate(found), minlength=len(known.intact))
                now[: len(times)] += times
                times = now
        yield summed()
        known.forget()
        release()

    return _texts(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


SUMS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def digests(docs: DataFrame, ranks: str | None = None, model: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, numbers of tokens, groups and links, links whose pair is the most frequent of its B id, sum of the links' counts, checksum of the groups.

    A row for each row of ``docs``; null and empty texts, and those whose tokens
    don't spell a space and the text, have zeros and an empty checksum.  Ties for
    the most frequent pair all count.  Further columns are ignored; no rows give
    no rows.  Texts are encoded twice, so no link is stored: once for the
    counts, once for the sums.  ``hot_pairs`` bounds what is broadcast and
    doesn't change a result.
    """
    spark = docs.sparkSession
    counts = materialize(pair_counts(docs, ranks, model), "pair-counts").withColumn("b_id", F.col("pair").bitwiseAND(0xFFFFFFFF))
    highest = counts.groupBy("b_id").agg(F.max("n").alias("highest"))  # a row for each id of B at most
    rated = materialize(counts.join(F.broadcast(highest), "b_id").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")
    rows, total = rated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # no more than hot_pairs pairs can have an equal share of the links or a larger one
    least = 1 if rows <= hot_pairs else -(-total // hot_pairs)
    hot = rated.where(F.col("n") >= least).toArrow()
    order = np.argsort(hot["pair"].to_numpy())
    shared = spark.sparkContext.broadcast((hot["pair"].to_numpy()[order], hot["n"].to_numpy()[order], hot["best"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_n, hot_best = shared.value
        known = Aligner(tokenizers(ranks, model), True)
        sums, best, rare = np.zeros(0, np.int64), np.zeros(0, np.int64), Column(np.int64)

        def rate() -> None:
            """Sums of the parts that are new."""
            nonlocal sums, best
            done = len(sums)
            lengths = known.pairs.lengths[done:]
            if not len(lengths):
                return
            pairs = known.pairs.values[known.pairs.starts[done] :]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            at = np.minimum(np.searchsorted(hot_keys, pairs), max(0, len(hot_keys) - 1))
            here = hot_keys[at] == pairs if len(hot_keys) else np.zeros(len(pairs), bool)
            n = np.zeros(len(pairs), np.int64)
            n[here] = hot_n[at[here]]
            top = np.zeros(len(pairs), bool)
            top[here] = hot_best[at[here]]
            added = np.zeros(len(lengths), np.int64)
            np.add.at(added, owner, n)  # whole numbers: exact at any size
            sums = np.concatenate([sums, added])
            best = np.concatenate([best, np.bincount(owner[top], minlength=len(lengths))])
            rare.add(pairs[~here], np.cumsum(np.bincount(owner[~here], minlength=len(lengths))))

        for batch in small(batches):
            if known.full():
                known.forget()
                sums, best, rare = np.zeros(0, np.int64), np.zeros(0, np.int64), Column(np.int64)
            found = known.read(batch["text"].to_pylist())
            rate()
            out: list[list] = [[] for _ in range(9)]
            for parts in found:
                if parts is None:
                    row = (0, 0, 0, 0, 0, 0, "", [], [])
                else:
                    rest, times = np.unique(rare.take(parts), return_counts=True)
                    text = ";".join([known.groups[i] for i in parts.tolist()])
                    lengths = (int(c.lengths[parts].sum()) for c in (known.a, known.b, known.group_a, known.pairs))
                    row = (*lengths, int(best[parts].sum()), int(sums[parts].sum()), hashlib.sha256(text.encode()).hexdigest(), rest, times)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [*[pa.int64()] * 6, pa.string(), *[pa.list_(pa.int64())] * 2]
            names = [x.split()[0] for x in SUMS.split(", ")] + ["rest", "times"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", *names])
        known.forget()
        release()

    placed = _texts(docs).mapInArrow(run, f"doc_id long, {SUMS}, rest array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed, "aligned")  # row numbers hold from here on
    shared.destroy()
    open_pairs = placed.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
    added = open_pairs.join(rated.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    whole = placed.join(added, "row", "left")
    plus = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256")
