"""Language identification by unigram models that sum over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A text's likelihood is the sum, over all ways to cut it into pieces, of the
product of their probabilities; a forward pass computes it.  A character that
is no piece itself may also be spelled in byte pieces.

Two characters that no piece holds side by side are parted in every
segmentation, so the sum is a product over the parts between such places.  Words
and parts recur; their likelihoods come from a memory of bounded size, and the
forward pass runs over all new parts of a batch at once.

The probabilities are fitted by expectation and maximisation on every training
text: parts are counted by language in the tasks, then by a grouping; each round
spreads the counts over the pieces of all segmentations by a forward and a
backward pass.  The driver
holds a number for each language and piece, whatever the size of the corpus.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import release, small
from quillmark.llm.store import materialize

MARK = "▁"
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Languages that one model tells apart; more are an error.
MOST_LANGUAGES = 1000
#: A word with the blanks before it, a line break, or blanks alone.
UNIT = re.compile(r" *[^ \n]+|\n| +")
#: Longer units and parts aren't remembered.
LONGEST_UNIT = 64
#: Units held by a task while they are counted; units and parts remembered with their likelihoods.
COUNTED, REMEMBERED = 150_000, 700_000
#: Characters of units that one forward pass covers at a time.
PASS_CHARS = 1 << 17

_loaded: dict[str, "Vocabulary"] = {}
#: The scorer of the model that this Python worker read with last.
_scorers: dict[str, "Scorer"] = {}


@dataclass
class Lattice:
    """All pieces that match inside parts of units; boundaries are numbered through, with one more than characters in each part."""

    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    part: np.ndarray
    first: np.ndarray
    last: np.ndarray
    unit: np.ndarray
    spelled: np.ndarray

    def _sweep(self, source: np.ndarray, target: np.ndarray, distance: np.ndarray, weights: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Log sums of paths from the ``known`` boundaries (0) to all others, by ``distance`` from them."""
        sums = np.full((int(self.last[-1]) + 1 if len(self.last) else 0, weights.shape[1]), -np.inf)
        sums[known] = 0.0
        most = int(distance.max(initial=0))
        distance = distance.astype(np.int16 if most < 2**15 else np.int64)
        order = np.argsort(target, kind="stable")  # a few sorted runs, merged
        order = order[np.argsort(distance[order], kind="stable")]
        source, target, weights = source[order], target[order], weights[order]
        bounds = np.searchsorted(distance[order], np.arange(1, most + 2))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            values = sums[source[low:high]] + weights[low:high]
            new = np.concatenate([[True], np.diff(target[low:high]) > 0])
            groups = np.flatnonzero(new)
            peak = np.maximum.reduceat(values, groups, axis=0)
            total = np.add.reduceat(np.exp(values - peak[np.cumsum(new) - 1]), groups, axis=0)
            sums[target[low:high][groups]] = peak + np.log(total)
        return sums

    def forward(self, weights: np.ndarray) -> np.ndarray:
        return self._sweep(self.begin, self.end, self.end - self.first[self.part], weights, self.first)

    def backward(self, weights: np.ndarray) -> np.ndarray:
        return self._sweep(self.end, self.begin, self.last[self.part] - self.begin, weights, self.last)

    def likelihoods(self, log_probs: np.ndarray, units: int) -> np.ndarray:
        """Log-likelihood of each unit under each column of ``log_probs``."""
        sums = self.forward(self.with_spelled(log_probs)[self.piece])
        out = np.zeros((units, log_probs.shape[1]))
        np.add.at(out, self.unit, sums[self.last])
        return out

    def with_spelled(self, log_probs: np.ndarray) -> np.ndarray:
        """A row for each piece, then one for each character that is spelled in bytes."""
        padded = np.vstack([log_probs, np.zeros((1, log_probs.shape[1]))])
        return np.vstack([padded, padded[self.spelled].sum(axis=1)])

    def expected(self, log_probs: np.ndarray, column: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the units, each of which counts ``times`` under its ``column``; a row for each piece."""
        pieces, languages = log_probs.shape
        mine = column[self.unit][self.part]
        weights = self.with_spelled(log_probs)[self.piece, mine][:, None]
        before, behind = self.forward(weights), self.backward(weights)
        share = np.exp(before[self.begin, 0] + weights[:, 0] + behind[self.end, 0] - before[self.last[self.part], 0]) * times[self.unit][self.part]
        rows = pieces + 1 + len(self.spelled)
        sums = np.bincount(self.piece * languages + mine, share, rows * languages).reshape(rows, languages)
        whole = sums[: pieces + 1]
        for k in range(4):
            np.add.at(whole, self.spelled[:, k], sums[pieces + 1 :])
        return whole[:pieces]


class Vocabulary:
    """The pieces of a model file as a trie in arrays."""

    def __init__(self, texts: list[str], ranks: list[float], byte_pieces: list[int]):
        """``texts`` of the pieces with ``ranks`` (0 is the most frequent); those in ``byte_pieces`` stand for the bytes in turn and have no text."""
        self.texts, self.byte_pieces = texts, np.array(byte_pieces)
        special = set(byte_pieces)
        plain = [(t.replace(MARK, " "), i) for i, t in enumerate(texts) if t and i not in special]
        nodes: dict[str, int] = {"": 0}
        for text, _ in plain:
            for k in range(1, len(text) + 1):
                nodes.setdefault(text[:k], len(nodes))
        self.piece_of = np.full(len(nodes), -1)
        for text, i in plain:
            self.piece_of[nodes[text]] = i
        edges = sorted(((nodes[t[:-1]] << 21) | ord(t[-1]), node) for t, node in nodes.items() if t)
        self.keys, self.children = np.array([k for k, _ in edges], np.int64), np.array([n for _, n in edges], np.int64)
        self.beside = np.array(sorted({(ord(t[k]) << 21) | ord(t[k + 1]) for t, _ in plain for k in range(len(t) - 1)}), np.int64)
        #: A unit may end before blanks and around line breaks only if no piece goes across.
        self.units_apart = not any("\n" in t or " " in t.lstrip(" ") for t, _ in plain)
        rank = np.array(ranks, float)
        prior = 1 / (2 + rank)
        self.prior = prior / prior.sum()

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i))]
        place = {model.id_to_piece(i): k for k, i in enumerate(ids)}
        return cls([model.id_to_piece(i) for i in ids], list(range(len(ids))), [place[f"<0x{b:02X}>"] for b in range(256)])

    def units(self, text: str) -> list[str]:
        marked = " " + text.replace(MARK, " ")
        return UNIT.findall(marked) if self.units_apart else [marked]

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.children[at], -1)

    def chars(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of all units, where their parts start, and the unit of each part."""
        c = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        bounds = np.cumsum([0] + [len(u) for u in units], dtype=np.int64)
        starts = np.ones(len(c), bool)
        pairs = (c[:-1] << 21) | c[1:]
        at = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        starts[1:] = self.beside[at] != pairs
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        begins = np.flatnonzero(starts)
        return c, begins, np.searchsorted(bounds, begins, "right") - 1

    def parts(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of all units in order, and the unit of each."""
        text = "".join(units)
        _, begins, unit = self.chars(units)
        at = begins.tolist()
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)], unit

    def lattice(self, units: list[str]) -> Lattice:
        c, begins, unit = self.chars(units)
        ends = np.append(begins[1:], len(c))
        part = np.repeat(np.arange(len(begins)), ends - begins)
        stop = ends[part] if len(begins) else ends[:0]
        at, state = np.arange(len(c)), self.find(c)
        found, alone, length = [], np.zeros(len(c), bool), 1
        while len(at):
            at, state = at[state >= 0], state[state >= 0]
            piece = self.piece_of[state]
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), length), piece[hit]))
            if length == 1:
                alone[at[hit]] = True
            inside = at + length < stop[at]
            at, state = at[inside], state[inside]
            state = self.find((state << 21) | c[at + length])
            length += 1
        odd = np.flatnonzero(~alone)
        letters, which = np.unique(c[odd], return_inverse=True)
        spelled = np.full((len(letters), 4), len(self.texts))
        for k, letter in enumerate(letters.tolist()):
            in_bytes = chr(letter).encode("utf-8", "surrogatepass")
            spelled[k, : len(in_bytes)] = self.byte_pieces[list(in_bytes)]
        found.append((odd, np.ones(len(odd), np.int64), len(self.texts) + 1 + which))
        begin, lengths, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        owner = part[begin]
        return Lattice(begin + owner, begin + owner + lengths, piece, owner, begins + np.arange(len(begins)), ends + np.arange(len(begins)), unit, spelled)


def vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of this file, loaded once in each process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _loaded:
        _loaded[path] = Vocabulary.load(path)
    return _loaded[path]


@dataclass(frozen=True)
class Settings:
    rounds: int = 2
    #: How many pieces of all languages together are added to each language's counts.
    smoothing: float = 500.0


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_probs: np.ndarray


def _passes(units: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of units with about PASS_CHARS characters."""
    start, size = 0, 0
    for k, unit in enumerate(units):
        size += len(unit)
        if size >= PASS_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(units):
        yield start, len(units)


def part_counts(docs: DataFrame, text: str, lang: str, path: str | None = None) -> DataFrame:
    """lang, part, n over all rows; counted in each task first, by units that are then cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        counts: dict[str, Counter] = {}

        def summed() -> Iterator[pa.RecordBatch]:
            for name, counter in counts.items():
                units, times = list(counter), list(counter.values())
                for a, b in _passes(units):
                    parts, unit = words.parts(units[a:b])
                    total: dict[str, int] = {}
                    for part, k in zip(parts, unit.tolist(), strict=True):
                        total[part] = total.get(part, 0) + times[a + k]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(total), pa.string()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "part", "n"])

        for batch in small(batches):
            for name, content in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                counts.setdefault(name, Counter()).update(words.units(content))
            if sum(map(len, counts.values())) > COUNTED:
                yield from summed()
                counts = {}
        yield from summed()
        counts = {}
        release()

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, part string, n long").groupBy("lang", "part").agg(F.sum("n").alias("n"))


def expected_counts(parts: DataFrame, languages: list[str], log_probs: np.ndarray, path: str | None = None) -> np.ndarray:
    """Expected numbers of pieces (rows) by language (columns)."""
    spark = parts.sparkSession
    shared = spark.sparkContext.broadcast(log_probs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, probs = vocabulary(path), shared.value
        place = {name: k for k, name in enumerate(languages)}
        total = np.zeros(probs.shape)
        for batch in small(batches, 1 << 15):
            column = np.array([place[x] for x in batch["lang"].to_pylist()])
            texts, times = batch["part"].to_pylist(), batch["n"].to_numpy()
            for a, b in _passes(texts):
                total += words.lattice(texts[a:b]).expected(probs, column[a:b], times[a:b])
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(language, pa.int64()), pa.array(total[piece, language], pa.float64())], ["piece", "language", "expected"])
        del total
        release()

    rows = parts.mapInArrow(run, "piece long, language long, expected double").groupBy("piece", "language").agg(F.sum("expected").alias("expected")).toArrow()
    shared.destroy()
    out = np.zeros(log_probs.shape)
    out[rows["piece"].to_numpy(), rows["language"].to_numpy()] = rows["expected"].to_numpy()
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings(), path: str | None = None) -> Model:
    """A model from all rows with a text and a language; without such rows, one without languages."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    seen = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(seen) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(seen)
    words = vocabulary(path)
    probs = np.repeat(words.prior[:, None], max(1, len(languages)), axis=1)
    if not languages:
        return Model([], np.zeros(0), np.log(probs))
    parts = materialize(part_counts(labelled, text, lang, path), "parts")
    for _ in range(settings.rounds):
        counts = expected_counts(parts, languages, np.log(probs), path)
        pooled = (counts / np.maximum(counts.sum(axis=0), 1e-9)).mean(axis=1)
        pooled = 0.9 * pooled + 0.1 * words.prior
        probs = counts + settings.smoothing * pooled[:, None]
        probs /= probs.sum(axis=0)
    n = np.array([seen[x] for x in languages], float)
    return Model(languages, np.log(n / n.sum()), np.log(probs))


class Rows:
    """Rows of numbers that are appended to; their room doubles."""

    def __init__(self, columns: int):
        self.held, self.n = np.empty((1024, columns)), 0

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            room = np.empty((2 * (self.n + len(more)), self.held.shape[1]))
            room[: self.n] = self.held[: self.n]
            self.held = room
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


class Scorer:
    """Likelihoods of texts; remembers those of units and of their parts."""

    def __init__(self, words: Vocabulary, log_probs: np.ndarray):
        self.words, self.log_probs = words, log_probs
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_parts: dict[str, int] = {}
        self.rows, self.part_rows = Rows(self.log_probs.shape[1]), Rows(self.log_probs.shape[1])

    def _learn(self, units: list[str]) -> np.ndarray:
        """Log-likelihoods of units: the sums over their parts, of which only new ones are computed."""
        parts, owner = self.words.parts(units)
        new = list(set(parts).difference(self.known_parts))
        found = [self.words.lattice(new[a:b]).likelihoods(self.log_probs, b - a) for a, b in _passes(new)]
        self.known_parts.update(zip(new, range(self.part_rows.n, self.part_rows.n + len(new))))
        for each in found:
            self.part_rows.append(each)
        rows = self.part_rows.held[np.fromiter(map(self.known_parts.__getitem__, parts), np.int64, len(parts))]
        for part in new:
            if len(part) > LONGEST_UNIT:
                del self.known_parts[part]
        return np.add.reduceat(rows, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)

    def read(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods of each text under each language."""
        if len(self.known) + len(self.known_parts) > REMEMBERED:
            self.forget()
        cut = [self.words.units(t) for t in texts]
        new = list(set().union(*cut).difference(self.known)) if cut else []
        if new:
            self.known.update(zip(new, range(self.rows.n, self.rows.n + len(new))))
            self.rows.append(self._learn(new))
        out = np.stack([self.rows.held[np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))].sum(axis=0) for units in cut])
        for unit in new:
            if len(unit) > LONGEST_UNIT:
                del self.known[unit]
        return out


def scorer(token: str, words: Vocabulary, log_probs: np.ndarray) -> Scorer:
    """The scorer of the model of this token; a worker's tasks share it, so each unit is learnt once by a worker, not by every task."""
    if token not in _scorers:
        _scorers.clear()
        _scorers[token] = Scorer(words, log_probs)
    return _scorers[token]


def predict(docs: DataFrame, model: Model, path: str | None = None) -> DataFrame:
    """doc_id, lang_pred and score (the language's share of the likelihood, weighted by its share of the training texts) of every row.

    Texts that are null or have no letter, and all texts under a model without
    languages, are ``und`` with score 0.  Ties go to the first language by name.
    Equal texts have equal predictions; repeated rows stay.  Further columns are
    ignored; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("read", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages)))
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = scorer(token, vocabulary(path), model.log_probs)
        for batch in small(batches):
            read = np.array(batch["read"].to_pylist(), bool)
            names, scores = np.full(len(read), UNKNOWN, object), np.zeros(len(read))
            if read.any():
                z = reader.read(batch["text"].filter(batch["read"]).to_pylist()) + model.log_prior
                best = z.argmax(axis=1)
                names[read] = np.array(model.languages, object)[best]
                scores[read] = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names.tolist(), pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])
        release()

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents by the checksum of the id; without an id, held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))
