"""Language models: all tokens of a block are turned into symbols at once, as ``letters`` turns each."""

import random

import numpy as np

from choicefield.llm import langid

SIGNS = "abZÄßİΣσςŉдЖ中あ́·_-',.'0٣²½Ⅷ①𝔘\U0001f600"


def plain_symbols(tokens):
    runs = ["".join(langid._START + r + langid._END for r in langid.letters(t)) for t in tokens]
    points = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.repeat(np.arange(len(tokens)), [len(r) for r in runs])


def test_symbols_are_the_runs_of_letters_without_a_call_a_token(monkeypatch):
    rng = random.Random(4)
    tokens = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(0, 9))) for _ in range(4000)] + ["ΟΔΟΣ", "ΑΣ²", "Σ", "a\nΣ b", "", "½²"]
    lists = [tokens, tokens[:1], [], [""], ["12"], ["a\nb"], ["x", "y\n"]]
    wanted = [plain_symbols(ts) for ts in lists]
    monkeypatch.setattr(langid, "letters", None)
    for ts, (points, owner) in zip(lists, wanted):
        found = langid.symbols(ts)
        assert found[0].dtype == np.uint64 and np.array_equal(found[0], points) and np.array_equal(found[1], owner)


def test_sums_of_a_batch_are_those_of_each_text():
    texts = ["the cat sat", None, "", "the dog, the cat", "  ", "und der Hund"]
    grams, counts = langid.gram_counts(langid.Counter("the cat sat on the dog und der Hund".split()))
    model = langid.fitted(["en"], np.zeros(len(grams), np.int64), grams, counts)
    sums, open_ = langid.Scorer(model).texts(texts)
    for text, found in zip(texts, sums):
        rows = model.tokens((text or "").split())
        assert np.array_equal(found, rows.sum(axis=0, dtype=np.float64))
    assert open_ == [[]] * len(texts)
    assert [len(x) for x in langid.Scorer(model).texts([])] == [0, 0]
