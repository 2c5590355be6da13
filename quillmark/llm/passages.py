"""Words, anchors and windows of texts, and what is left of a text without passages; with numpy, inside tasks.

Words lie between blanks and line breaks.  Texts are read as UTF-8, so places
are bytes until words are counted.  Several texts are read at once, parted by a
line break; nothing reaches over the end of a text.
"""

from __future__ import annotations

import numpy as np

from quillmark.llm.shingles import grams, hashed_words, stretches

LONG_LINE = 120
SALT = 0x2545F4914F6CDD1D


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text, and hash, start and end of each word."""
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return codes, *hashed_words(codes, (codes == 32) | (codes == 10))


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """At each place the least of the ``length`` values from there."""
    size, low = 1, values
    while 2 * size <= length:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    rest = length - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def groups(texts: list[str], most: int = 1 << 18):
    """(from, to) of neighbouring texts that are read at once: up to about ``most`` characters, one text at least."""
    at = size = 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > most:
            yield at, k
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and how many words each text has."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"\n".join(data), np.uint8)
    words, starts, _ = hashed_words(codes, (codes == 32) | (codes == 10))
    ends = np.cumsum([len(d) + 1 for d in data])
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def _repeats(text: np.ndarray, h: np.ndarray, d: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """Whether h and d stand before in the same text, at least ``distance`` words away."""
    own = np.zeros(len(h), bool)
    if len(np.unique(h)) == len(h):
        return own
    order = np.lexsort((starts, d, h, text))
    text, h, d = text[order], h[order], d[order]
    same = np.concatenate(([False], (text[1:] == text[:-1]) & (h[1:] == h[:-1]) & (d[1:] == d[:-1])))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    own[order] = same & (starts[order] >= starts[order[first]] + distance)
    return own


def anchors(texts: list[str], least_words: int) -> tuple[np.ndarray, ...]:
    """text, start, stop, h, d, own: in that text the windows of ``least_words`` words from start to before stop have the anchor h; d hashes all their words."""
    words, counts = _joined(texts)
    gram = max(1, least_words // 3)
    reach = least_words - gram + 1
    held = np.maximum(counts - least_words + 1, 0)  # windows of each text
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(texts)), held)
    if not len(text):
        return text, text, text, text, text, np.zeros(0, bool)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(held) - held, held)
    at = first[text] + inside
    low = _least(grams(words, gram), reach)[at]
    begins = inside == 0
    begins[1:] |= low[1:] != low[:-1]
    # windows a whole reach apart with one anchor hold two occurrences of it
    begins[reach:] |= (inside[reach:] >= reach) & (low[reach:] == low[:-reach])
    place = np.flatnonzero(begins)
    text, start = text[place], inside[place]
    stop = np.minimum(start + np.diff(place, append=len(low)), held[text])
    h, d = low[place].view(np.int64), stretches(words, first[text] + start, first[text] + stop + least_words - 1).view(np.int64)
    return text, start, stop, h, d, _repeats(text, h, d, start, least_words)


def windows(texts: list[str], spans: list[list[dict]], least_words: int) -> tuple[np.ndarray, ...]:
    """text, start, stop, h, d, own of each single window from a span's start to before its stop; h and d hash its words."""
    words, counts = _joined(texts)
    first = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(texts)), [len(s) for s in spans])
    low = np.array([x["start"] for s in spans for x in s], np.int64)
    n = np.array([x["stop"] for s in spans for x in s], np.int64) - low
    text = np.repeat(of, n)
    start = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[text] + start
    h, d = (stretches(words, at, at + least_words, salt).view(np.int64) for salt in (0, SALT))
    return text, start, start + 1, h, d, _repeats(text, h, d, start, least_words)


def _covered(starts: np.ndarray, stops: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of words that windows cover."""
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate(stops[order] + least_words - 1)
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def without(text: str, starts: np.ndarray, stops: np.ndarray, least_words: int) -> tuple[str, int]:
    """What is left of a text without the windows, and how many passages went.

    A short line at a passage's edge of which the passage covers half or less
    stays whole; a line cut off at its end keeps its line break.
    """
    codes, _, at, end = words_of(text)
    n = len(at)
    low, high = _covered(starts, stops, least_words)
    after = np.append(at[1:], len(codes))
    breaks = np.concatenate(([0], np.cumsum(codes == 10)))
    broken = breaks[after] > breaks[end]  # words with a line break behind them
    ends = np.flatnonzero(broken) + 1
    runs = []

    def line(word: int) -> tuple[int, int, bool]:
        k = np.searchsorted(ends, word, "right")
        a, b = int(ends[k - 1]) if k else 0, int(ends[k]) if k < len(ends) else n
        body = codes[at[a] : end[b - 1]]
        return a, b, int(((body & 0xC0) != 0x80).sum()) < LONG_LINE

    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        first, last = line(a), line(b - 1)
        little = [short and 2 * (min(b, y) - max(a, x)) <= y - x for x, y, short in (first, last)]
        a, b = first[1] if little[0] else a, last[0] if little[1] else b
        if a < b:
            runs.append((a, b))
    if not runs:
        return text, 0
    data, kept, done = codes.tobytes(), [], 0
    for a, b in runs:
        kept.append(data[done : at[a] if a else 0])
        if a and broken[b - 1] and not broken[a - 1]:
            kept.append(data[end[b - 1] : after[b - 1]])
        done = after[b - 1]
    kept.append(data[done:])
    return b"".join(kept).decode("utf-8", "surrogatepass"), len(runs)
