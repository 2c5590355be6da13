"""Viterbi by a stream against brute force on random texts; what it remembers."""

import random

import numpy as np
import pytest

from quillmark.llm import pieces
from tests.llm.test_edges import brute_viterbi


@pytest.mark.parametrize("seed", range(3))
def test_streaming_viterbi_of_random_texts(seed):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(seed)
    model = pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    for n in (1, 7, 60, 900):
        text = "".join(rng.choices("etaoinshr" if seed else "ab \n日\U0001f600q.", k=n))
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        assert np.frombuffer(model.encode(text), "<u4").tolist() == brute_viterbi(model, marked) == [i for run in model.stream(marked) for i in run]
        assert model.decode(np.frombuffer(model.encode(text), "<u4").tolist()) == text
    # lines share what is remembered of their words
    assert not any("\n" in word and len(word) > 1 for word in model.known)
