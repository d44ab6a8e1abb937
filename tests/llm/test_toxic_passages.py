"""Every toxic passage is found, whatever its words did earlier in the text."""

from priorframe.llm.toxicity import ToxicityModel

BAD = [f"bad{k}" for k in range(6)]
MODEL = ToxicityModel({w: 3.0 for w in BAD}, decay=1.0, log_k=-1.0)


def test_scattered_words_before_a_passage():
    words = [w for b in BAD for w in [b, *["plain"] * 100]] + BAD
    evidence, found = MODEL.evidence(words)
    assert [(a, b) for a, b, _ in found] == [(len(words) - 6, len(words))] and evidence > 5


def test_second_passage_of_the_same_words():
    words = [*BAD, *["plain"] * 200, *BAD]
    assert [(a, b) for a, b, _ in MODEL.evidence(words)[1]] == [(0, 6), (206, 212)]
