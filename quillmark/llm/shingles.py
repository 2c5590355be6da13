"""Hashed word shingles of one text, with numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multipliers from the fractional part of the golden ratio, one for each place in a shingle.
_GOLDEN = 0x9E3779B97F4A7C15
_PRIME = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all others."""
    x = (x ^ (x >> _U(32))) * _PRIME
    x = (x ^ (x >> _U(29))) * _PRIME
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, base, _U), dtype=_U)


class _Tables:
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    up = np.ones(1, _U)
    down = np.ones(1, _U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Tables.up) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _Tables.up, _Tables.down = _powers(_Tables.base, size), _powers(_Tables.inverse, size)
    return _Tables.up, _Tables.down


def hashed_words(codes: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of codes that aren't blank, and where the runs start and end."""
    if not len(codes):
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.concatenate(([True], blank, [True]))
    starts = np.flatnonzero(inside[:-2] & ~inside[1:-1])
    ends = np.flatnonzero(~inside[1:-1] & inside[2:]) + 1
    up, down = _tables(len(codes) + 1)
    with np.errstate(over="ignore"):
        # the sum of code * base**place over a word, divided by base**start
        sums = np.zeros(len(codes) + 1, _U)
        np.cumsum((codes.astype(_U) + _U(1)) * up[: len(codes)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U)), starts, ends


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text, A-Z as a-z; words are what lies between ASCII white space."""
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    return hashed_words(codes, (codes == 32) | ((codes >= 9) & (codes <= 13)))[0]


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row."""
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(max(0, n), width, _U)
        for k in range(width):
            total = mix(total * _U(_GOLDEN) + words[k : k + n])
    return total


def stretches(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of the words of each stretch from start to before stop, whatever its place."""
    up, down = _tables(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, _U)
        np.cumsum(mix(words + _U(salt)) * up[: len(words)], out=sums[1:])
        return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(_U))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of ``width`` words; the whole sequence if it is shorter."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    return np.unique(grams(words, min(width, len(words))))
