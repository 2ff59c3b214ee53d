import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from choicefield.llm import common, ngram_join, shingles  # noqa: E402

SCHEMA = "doc_id long, text string"


def got(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, ngram_join.jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def made_up():
    rng = random.Random(3)
    passage = words(rng, 30, 30)
    rows, texts = [], []
    for _ in range(60):
        text = words(rng, rng.choice([1, 3, 4, 12, 40, 90]))
        if rng.random() < 0.5:
            text[len(text) // 2:len(text) // 2] = passage
        texts.append(text)
    for _ in range(90):  # near and exact copies, chains of them too
        text = list(rng.choice(texts))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = "edit"
        texts.append(text)
    rng.shuffle(texts)
    rows = [(i, rng.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(texts)]
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "oNE TWO"), (5, rows[5][1]), (6, "quite another text here"), (None, rows[0][1]), (None, None)]


@pytest.mark.parametrize("small", [32, 2])
def test_matches_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    rows = made_up()
    assert got(spark, rows) == brute.components(rows)


def test_one_large_group_and_threshold(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 4)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 50] + ["x"] + base[i % 50 + 1:])) for i in range(80)]
    exact = [f"c{i}" for i in range(103)]  # 100 shingles; 85 shared of 100: exactly at the border
    rows += [(200, " ".join(exact)), (201, " ".join(exact[:88])), (202, " ".join(exact[:87]))]
    assert got(spark, rows) == brute.components(rows)


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    frame = spark.createDataFrame([(1, "a b c d e", 7, 8, "n"), (2, "a b c d e", 7, 8, "n")],
                                  "doc_id long, text string, component_id int, n_shingles int, node string")
    assert sorted(map(tuple, ngram_join.jaccard_components(frame).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_long_text_is_read_whole(monkeypatch):
    rng = random.Random(1)
    text = " ".join(words(rng, 5000, 3000)).encode()
    whole = list(shingles.shingle_sets([text, b"a b"], 4))
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets([text, b"a b"], 4)))
    assert len(whole[0]) == len(brute.shingles(text.decode()))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 50), (60, 61), (61, 60)], "a long, b long")
    roots = {r.node: r.root for r in common.components(edges).collect()}
    assert roots == {i: 0 for i in range(41)} | {60: 60, 61: 60}
