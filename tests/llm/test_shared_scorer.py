"""What one task of a Python worker learns of units serves the next."""

import numpy as np

from quillmark.llm import langid


def test_tasks_of_a_worker_share_what_they_learnt():
    words = langid.vocabulary()
    probs = np.log(np.repeat(words.prior[:, None], 2, axis=1))
    first = langid.scorer("one", words, probs)
    alone = langid.Scorer(words, probs).read(["some words", "more words"])
    assert (first.read(["some words", "more words"]) == alone).all()
    again = langid.scorer("one", words, probs)
    assert again is first and " words" in again.known
    assert (again.read(["more words"]) == alone[1:]).all()
    assert langid.scorer("two", words, probs) is not first and list(langid._scorers) == ["two"]
    langid._scorers.clear()
