"""Toxicity by multiple-instance learning.

Only documents are labelled.  A sentence with known words is toxic with
``p = sigmoid(bias + sum of its distinct words' weights)``, one without with 0;
a document is toxic if any sentence is (noisy-or): ``P = 1 - prod(1 - p)``.  The
weights are fitted on document labels through that product, so the sentences
that carry the label get the probability, and can be shown.

The model is fitted in one task, on a bounded sample of labelled rows
(``Settings.sample`` for each label, none longer than ``Settings.longest``); it has
``Settings.words`` weights at most.  Every text is scored whole, where it lies.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.batches import release, small, values
from quillmark.llm.store import materialize

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORD = re.compile(r"\w+")
#: Inflected words are known by how they begin: a word's features are itself and its beginnings of these lengths.
BEGINNINGS = (3, 4, 5, 6, 7)
FOLDS = 5


def features(words: set[str]) -> set[str]:
    """The words and, marked with ``*``, their beginnings."""
    found = set(words)
    for n in BEGINNINGS:
        found.update([w[:n] + "*" for w in words if len(w) >= n])
    return found


@dataclass(frozen=True)
class Settings:
    sample: int = 4000
    longest: int = 20_000
    words: int = 1024
    least_documents: int = 10
    rounds: int = 400
    rate: float = 0.1
    penalty: float = 3e-5
    smallest_weight: float = 0.25


NONE: frozenset[str] = frozenset()


class Known(dict):
    """The weighted features of a word, found when first asked for."""

    #: Bytes of words held; a word takes about this much besides its characters.
    limit, entry = 24_000_000, 160

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights, self.size = weights, 0

    def __missing__(self, word: str) -> frozenset[str]:
        self.size += self.entry + len(word)
        if self.size > self.limit:
            self.clear()
            self.size = self.entry + len(word)
        # most words have none; they share one empty set
        self[word] = found = frozenset(features({word}) & self.weights.keys()) or NONE
        return found


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def reader(self) -> "Reader":
        return Reader(self)


class Reader:
    """Reads texts with a model; holds what it has seen of words."""

    def __init__(self, model: Model):
        self.bias, self.weights, self.known = model.bias, model.weights, Known(model.weights)

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, evidence) of each sentence with a known feature; its probability is ``1 - exp(-evidence)``."""
        text = text or ""
        lowered = text.lower()
        words = {w for w in set(WORD.findall(lowered)) if self.known[w]}
        if not words:
            return []
        found = []
        # lower-casing may lengthen a text, but its sentences stay the same: places are those in the text as it is
        for match, lower in zip(SENTENCE.finditer(text), SENTENCE.findall(lowered), strict=True):
            here = words.intersection(WORD.findall(lower))
            if here:
                z = self.bias + sum(self.weights[f] for f in sorted(frozenset().union(*(self.known[w] for w in here))))
                found.append((match.start(), match.end(), float(np.logaddexp(0.0, z))))
        return found


def held_out(doc_id):
    """Every fifth document by the checksum of its id; without an id, held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, float]:
    """The bounded sample (text, toxic) and the share of toxic rows among all labelled ones."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "labelled")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    pick = lambda label: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    chosen = pick(1).union(pick(0))  # at most twice settings.sample rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.length("text") <= settings.longest))
    return rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic").dropDuplicates(), share


def fit_weights(texts: list[str], toxic: np.ndarray, share: float, settings: Settings) -> Model:
    """Weights that maximise the likelihood of the documents' labels, the classes weighted to their share."""
    with_word = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        with_word[int(label)].update(features(set(WORD.findall(text.lower()))))
    totals = [max(1, int((toxic == label).sum())) for label in (0, 1)]

    def separates(word: str) -> float:
        """The log-likelihood ratio of a word's presence and the label."""
        ratio = 0.0
        seen = [with_word[0][word], with_word[1][word]]
        overall = sum(seen) / sum(totals)
        for n, total in zip(seen, totals, strict=True):
            for part, expected in ((n, overall * total), (total - n, (1 - overall) * total)):
                ratio += part * math.log(part / expected) if part else 0.0
        return ratio

    frequent = [w for w in with_word[0].keys() | with_word[1].keys() if with_word[0][w] + with_word[1][w] >= settings.least_documents]
    words = sorted(frequent, key=lambda w: (-separates(w), w))[: settings.words]
    index = {w: k for k, w in enumerate(words)}
    del with_word, frequent
    owner, row, column = array("i"), array("i"), array("i")
    for k, text in enumerate(texts):
        for sentence in SENTENCE.findall(text.lower()):
            known = [index[w] for w in features(set(WORD.findall(sentence))) if w in index]
            if known:
                row.extend([len(owner)] * len(known))
                column.extend(known)
                owner.append(k)
    if not owner:
        return Model(-10.0, {})
    owner, row, column = np.array(owner, np.intp), np.array(row, np.intp), np.array(column, np.intp)
    n, sentences_n = len(texts), len(owner)
    weight = np.where(toxic == 1, share / totals[1], (1 - share) / totals[0])
    theta = np.zeros(len(words) + 1)
    theta[-1] = -4.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, settings.rounds + 1):
        z = theta[-1] + np.bincount(row, theta[column], sentences_n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        evidence = np.maximum(np.bincount(owner, np.logaddexp(0, z), n), 1e-12)
        # d(-log likelihood)/d(evidence): 1 for label 0, -1 / (exp(evidence) - 1) for label 1
        slope = weight * np.where(toxic == 1, -1 / np.expm1(np.minimum(evidence, 50)), 1.0)
        by_sentence = slope[owner] * p
        gradient = np.append(np.bincount(column, by_sentence[row], len(words)) + settings.penalty * theta[:-1], by_sentence.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        theta -= settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[-1]), {w: float(t) for w, t in zip(words, theta, strict=False) if abs(t) >= settings.smallest_weight})


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from the labelled rows that aren't held out; with none of either label, one that scores 0."""
    rows, share = training_rows(docs, labels, settings)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((text, label) for b in batches for text, label in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True))
        toxic = np.array([label for _, label in sample], np.int64)
        model = fit_weights([text for text, _ in sample], toxic, share, settings) if 0 < toxic.sum() < len(toxic) else Model(-10.0, {})
        del sample, toxic
        release()
        yield pa.RecordBatch.from_arrays([pa.array(["", *model.weights], pa.string()), pa.array([model.bias, *model.weights.values()], pa.float64())], ["word", "weight"])

    # one task by design: the sample is bounded
    fitted = materialize(rows.coalesce(1).mapInArrow(train, "word string, weight double"), "toxicity-model").collect()
    weights = {r["word"]: r["weight"] for r in fitted}
    return Model(weights.pop("", -10.0), weights)


SCORED = "score double, predicted int, n_offending int, worst_start int, worst_end int, worst_score double"


def _score(batches: Iterator[pa.RecordBatch], model: Model, keep: list[str]) -> Iterator[pa.RecordBatch]:
    reader = model.reader()
    for batch in small(batches):
        columns: list[list] = [[] for _ in range(6)]
        for text in batch["text"].to_pylist():
            found = reader.sentences(text)
            score = -math.expm1(-sum(e for _, _, e in found)) if found else 0.0
            offending = [(e, -a, b) for a, b, e in found if -math.expm1(-e) >= 0.5]
            worst = max(((e, -a, b) for a, b, e in found), default=None)
            at = (-worst[1], worst[2], -math.expm1(-worst[0])) if worst else (None, None, None)
            for column, value in zip(columns, (score, int(score >= 0.5), len(offending), *at), strict=True):
                column.append(value)
        types = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        names = [x.split()[0] for x in SCORED.split(", ")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keep, *names])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, held_out and the score of every row, with the place of its worst sentence.

    Null, empty and unknown texts score 0 and have no worst sentence.  Equal
    texts score alike.  Further columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(lambda batches: _score(batches, model, ["doc_id", "text"]), f"doc_id long, text string, {SCORED}")
    return out.withColumn("held_out", held_out(F.col("doc_id")))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence and probability of each sentence at or above ``least``."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            rows = [(d, a, b, t[a:b], -math.expm1(-e)) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for a, b, e in reader.sentences(t) if -math.expm1(-e) >= least]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "end", "sentence", "probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(locate, "doc_id long, start int, end int, sentence string, probability double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    hidden = "__toxicity"

    def mark(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = model.reader()
        for part in texts:
            yield pa.array([-math.expm1(-sum(e for _, _, e in reader.sentences(t))) for t in values(part)], pa.float64())
        del reader
        release()

    marked = docs.withColumn(hidden, F.arrow_udf(mark, "double")(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return marked.where(F.col(hidden) < threshold).drop(hidden)
