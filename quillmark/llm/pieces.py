"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation under a unigram model is found left to right.  Only the
scores of the last ``longest piece`` positions are kept; a start whose characters
no piece continues has no surviving path, and once the surviving paths all pass
one boundary, the ids before it are committed.

Where no piece holds a word mark after another character, a word mark that
follows another character is always such a boundary, so words are remembered
with their ids.  So is each side of a line break, where no piece holds one beside
another character.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words remembered by one Python worker; beyond it the memory starts anew.
MEMORY = 600_000
LONGEST_WORD = 64
UNIT = 2.0**-24

_loaded: dict[str, "Pieces"] = {}


def _packed(node: dict) -> dict[str, tuple[dict | None, int, int]]:
    """A trie's node with what is looked up together held together."""
    return {char: (_packed(below) if len(below) > ("" in below) else None, *below.get("", (-1, 0))) for char, below in node.items() if char}


class Pieces:
    """The pieces of a model file with log-probabilities.

    A unigram model has them; the ranks of a byte-pair model count as Zipf's:
    ``-log(rank + 2)``, normalised.  A character of no piece is written in bytes.
    Scores are held in whole units of ``UNIT``, so sums are exact and ties the
    same wherever a sum starts.
    """

    def __init__(self, texts: list[str], scores: list[float], byte_ids: dict[int, int]):
        self.texts, self.byte_ids = texts, byte_ids
        self.spelling = [t.encode() for t in texts]
        for byte, i in byte_ids.items():
            self.spelling[i] = bytes([byte])
        self.trie: dict = {}
        self.longest = 1
        special = set(byte_ids.values())
        for i, (text, score) in enumerate(zip(texts, scores, strict=True)):
            if text and i not in special and score > -math.inf:
                node = self.trie
                for char in text:
                    node = node.setdefault(char, {})
                node[""] = (i, round(score / UNIT))
                self.longest = max(self.longest, len(text))
        #: For each character that goes on: what may follow it (or None), the piece that ends there (or -1) and its score.
        self.begin = _packed(self.trie)
        self.alone = {char for char, (_, piece, _) in self.begin.items() if piece >= 0}
        self.byte_score = round((min(s for s in scores if s > -math.inf) - 10.0) / UNIT)
        self.words_apart = not any(MARK in t.lstrip(MARK) for i, t in enumerate(texts) if i not in special)
        lines_apart = not any("\n" in t and len(t) > 1 for i, t in enumerate(texts) if i not in special)
        self.word = LINE_WORD if lines_apart else WORD
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(n)]
        ranked = all(float(model.get_score(i)).is_integer() for i in range(n) if plain[i])
        if ranked:
            weights = [1 / (2 - model.get_score(i)) if plain[i] else 0.0 for i in range(n)]
            total = sum(weights)
            scores = [math.log(w / total) if w else -math.inf for w in weights]
        else:
            scores = [model.get_score(i) if plain[i] else -math.inf for i in range(n)]
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        return cls([model.id_to_piece(i) for i in range(n)], scores, byte_ids)

    def stream(self, chars: str) -> Iterator[list[int]]:
        """Runs of ids, each as soon as it is certain."""
        begin, alone, byte_score, n = self.begin, self.alone, self.byte_score, len(chars)
        best: dict[int, int] = {0: 0}  # scores of boundaries from here to where pieces reach
        back: dict[int, tuple[int, int | list[int]]] = {}
        committed = reach = 0
        wait = 4 * self.longest
        for start in range(n):
            # pieces from all earlier starts are known, so this boundary is settled
            if start > committed and (reach <= start or start - committed >= wait):
                meeting = start if reach <= start else self._meeting(back, committed, start, best)
                wait = 4 * self.longest if meeting > committed else 2 * (start - committed)
                if meeting > committed:
                    yield self._path(back, committed, meeting)
                    for position in range(committed + 1, meeting + 1):
                        del back[position]
                    committed = meeting
            score, node, end = best.pop(start), begin, start
            while node is not None and end < n:
                found = node.get(chars[end])
                if found is None:
                    break
                node, piece, weight = found
                end += 1
                if piece >= 0 and (end not in best or score + weight > best[end]):
                    best[end], back[end] = score + weight, (start, piece)
                    if end > reach:
                        reach = end
            # a character that is a piece is never spelled: bytes score less than any piece
            if (char := chars[start]) not in alone:
                spelled = [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
                end = start + 1
                if end not in best or score + byte_score * len(spelled) > best[end]:
                    best[end], back[end] = score + byte_score * len(spelled), (start, spelled)
                    reach = max(reach, end)
        if committed < n:
            yield self._path(back, committed, n)

    @staticmethod
    def _meeting(back: dict, committed: int, start: int, best: dict[int, int]) -> int:
        """The boundary where all surviving paths meet: those to ``start`` and those to each boundary that pieces reach behind it."""
        heads = {start, *(back[end][0] for end in best if end > start)}
        while len(heads) > 1:
            last = max(heads)
            heads.remove(last)
            heads.add(back[last][0] if last > committed else committed)
        return heads.pop()

    @staticmethod
    def _path(back: dict, start: int, end: int) -> list[int]:
        runs = []
        while end > start:
            end, ids = back[end]
            if isinstance(ids, int):
                runs.append(ids)
            else:
                runs += reversed(ids)
        runs.reverse()
        return runs

    def _word(self, word: str) -> bytes:
        ids = array("I", [i for run in self.stream(word) for i in run]).tobytes()
        if len(word) <= LONGEST_WORD:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; a text starts with a word mark, an empty one has none."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        if not self.words_apart:
            return np.array([i for run in self.stream(marked) for i in run], "<u4").tobytes()
        known = self.known
        words = self.word.findall(marked)
        return b"".join([known.get(w) or self._word(w) for w in words])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; word marks are blanks, but for the first."""
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text.removeprefix(MARK).replace(MARK, " ")


#: A run of word marks with what follows it.
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: The same up to a line break, or a line break.
LINE_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def pieces(path: str | None = None) -> Pieces:
    """The model of this file, loaded once in each Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _loaded:
        _loaded[path] = Pieces.load(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32 and round_trip (whether decoding gives the text) of every row.

    Null and empty texts have no ids.  Equal texts have equal ids.  A text that
    itself holds a word mark decodes to a blank there and isn't a round trip.
    Ties go to the longer last piece.  Further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            found = [model.encode(t or "") for t in batch["text"].to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in found], dtype=np.int32)
            values = np.frombuffer(b"".join(found), "<i4")
            intact = [model.decode(values[a:b].tolist()) == (t or "") for a, b, t in zip(ends[:-1], ends[1:], batch["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(np.diff(ends)), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(intact)],
                ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids int, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
