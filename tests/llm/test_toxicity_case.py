import pytest

from quillmark.llm.toxicity import Model


@pytest.mark.parametrize("start", ["Iki. ", "\u0130ki \u0130. "])
def test_upper_case_words_are_known_whatever_the_length(start):
    text = start + "YOU ARE VILE! The End."
    found = Model(-3.0, {"vile": 6.0}).reader().sentences(text)
    assert [text[a:b].strip() for a, b, _ in found] == ["YOU ARE VILE!"]
    assert found[0][2] == pytest.approx(3.0485873)
