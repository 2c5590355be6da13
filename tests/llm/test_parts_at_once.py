"""Parts that tokenizer A reads as one text have the ids that they have one by one."""

import random

import numpy as np

from quillmark.llm import align


class Counted:
    """Tokenizer A, counting its calls."""

    def __init__(self, a):
        self.a, self.calls = a, 0

    def encode_ordinary(self, text):
        self.calls += 1
        return self.a.encode_ordinary(text)


def test_even_parts_are_read_at_once(monkeypatch):
    both = align.tokenizers()
    counted = Counted(both.a)
    monkeypatch.setattr(both, "a", counted)
    rng = random.Random(5)
    alphabet = "abcdefXYZ019.,;!?'\"-_()<|>/é漢字🙂́‍­"
    parts = sorted({rng.choice([" ", "\n"]) + "".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(2000)})
    a, b, a_bounds, b_bounds, bounds, intact = both.checked(parts)
    assert counted.calls < 10 or not intact.all()
    for k, part in enumerate(parts):
        if intact[k]:
            assert a[a_bounds[k - 1] if k else 0 : a_bounds[k]].tolist() == counted.a.encode_ordinary(part)
    fine = [p for p, ok in zip(parts, intact, strict=True) if ok]
    counted.calls = 0
    a, b, a_bounds, b_bounds, bounds, intact = both.checked(fine)
    assert counted.calls == 1 and intact.all()
    ids = [x.tolist() for x in np.split(a, a_bounds[:-1])]
    assert ids == [counted.a.encode_ordinary(p) for p in fine]
    assert [x.tolist() for x in np.split(b, b_bounds[:-1])] == both.b_ids(fine)
    assert bounds.tolist() == np.cumsum([len(p.encode()) for p in fine]).tolist()


def test_uneven_parts_do_not_slow_the_others(monkeypatch):
    both = align.tokenizers()
    counted = Counted(both.a)
    monkeypatch.setattr(both, "a", counted)
    texts = [" ".join(f"word{k}x{j}" for j in range(50)) for k in range(20)] + ["two  blanks", "tab\tend ", None, ""]
    found = align.Aligner(both, True).read(texts)
    assert counted.calls < 10
    assert [x is None for x in found] == [False] * 22 + [True, True]
