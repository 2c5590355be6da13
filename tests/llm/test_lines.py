"""Repeated passages in lines, over short lines, between blank lines and without punctuation, against a brute-force version."""

import random

import pytest

from quillmark.llm import lines

DOCS = "doc_id long, text string"


def cleaned(spark, texts):
    got = lines.without_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    return [r.clean_text for r in sorted(got, key=lambda r: r.doc_id)]


def words(rng, n, label="w"):
    return [f"{label}{rng.randrange(10**6)}" for _ in range(n)]


def brute(texts, least=25):
    """What stays of each text, in words, if all are one long line."""
    seen, out = {}, []
    for doc, text in enumerate(texts):
        own, gone = text.split(), set()
        for p in range(len(own) - least + 1):
            first = seen.setdefault(tuple(own[p : p + least]), (doc, p))
            if first[0] != doc or p >= first[1] + least:
                gone.update(range(p, p + least))
        out.append([w for i, w in enumerate(own) if i not in gone])
    return out


def test_passages_inside_lines_without_punctuation(spark):
    rng = random.Random(1)
    passages = [words(rng, n, "p") for n in (24, 25, 26, 40, 51, 60, 75, 100) * 4]
    texts = [" ".join(words(rng, 30) + p + words(rng, 30)) for p in passages for _ in range(2)]
    # one after the other, edited in the middle, within one text, of one word, and with a later start
    texts += [" ".join(passages[7] + passages[5] + ["edited"] + passages[7][:49] + ["x"] + passages[7][50:]), " ".join((own := words(rng, 40)) + words(rng, 3) + own), "word " * 99, " ".join(passages[6][20:] + words(rng, 5))]
    got = cleaned(spark, texts)
    assert [t.split() for t in got] == brute(texts)
    assert all(p[0] not in t and p[-1] not in t for p, t in zip(passages, got[1:64:2], strict=True) if len(p) >= 25)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = words(rng, 400)
    texts = []
    for _ in range(60):
        cuts = [(i := rng.randrange(380), rng.randrange(i, 400)) for _ in range(rng.randrange(1, 6))]
        texts.append(" ".join(["q" * 120] + [w for a, b in cuts for w in [*pool[a:b], *words(rng, rng.randrange(3))]]))
    assert [t.split() for t in cleaned(spark, texts)] == brute(texts)


def test_passages_over_short_lines(spark):
    rng = random.Random(2)
    shared = [" ".join(words(rng, 8)) for _ in range(8)]
    texts = ["\n".join([" ".join(words(rng, 9)), *shared, " ".join(words(rng, 9))]) for _ in range(3)]
    got = cleaned(spark, texts)
    assert got[0] == texts[0]
    assert all(t == "\n".join([o.split("\n")[0], o.split("\n")[-1]]) for t, o in zip(got[1:], texts[1:], strict=True))
    # a short line covered by half or less stays whole
    first = f"one two {' '.join(shared[:5])}\nend here now"
    assert cleaned(spark, [first, f"other\n{chr(10).join(shared[:5])}\nend of it all"])[1] == "other\nend of it all"


def test_a_line_break_after_a_passage_stays(spark):
    shared = " ".join(words(random.Random(3), 60))
    assert cleaned(spark, [f"a {shared}\nb", f"c {shared}\n\nd e"])[1].split("\n") == ["c ", "", "d e"]


def test_short_paragraphs_between_blank_lines(spark):
    for seed in range(2):
        rng = random.Random(seed)
        shared = [" ".join(words(rng, 20, "paragraph")) for _ in range(3)]
        texts = ["\n\n".join([f"own start {i}", *shared, f"end {i} of it"]) for i in "ab"]
        assert cleaned(spark, texts) == [texts[0], "own start b\n\nend b of it"]
