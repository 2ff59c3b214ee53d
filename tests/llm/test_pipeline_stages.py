"""Stages of the corpus pipeline against plain second versions."""

import random
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from choicefield.llm import ngram_join  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_stage(spark, rows):
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    return Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, frame, "").collect())


def components(rows, monkeypatch):
    shingles = brute.shingles
    monkeypatch.setattr(brute, "shingles", lambda text: shingles(text, 5))
    return brute.components(rows, 80)


def test_near_duplicates_share_four_fifths_of_five_word_shingles(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for i in range(30):
        text = [f"w{rng.randrange(500)}" for _ in range(104)]  # 100 shingles
        rows += [(10 * i, " ".join(text)), (10 * i + 1, " ".join(text + [f"x{k}" for k in range(10 + i)]))]  # 100 of 110 to 139
        rows.append((10 * i + 2, " ".join([*text[:50], "edit", *text[51:99], "edit", *text[100:]])))
    got = near_stage(spark, rows)
    groups = components(rows, monkeypatch)
    assert {d for d, _ in got} == {d for d, _, c in groups if d == c} and sum(got.values()) == len(got)
    assert (10 * 8 + 1) not in {d for d, _ in got}  # 100 of 118 shingles: between the two thresholds
    assert {d for d, _, c in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect() if d == c} > {d for d, _ in got}


def test_unlike_documents_stay_under_null_and_repeated_ids(spark):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"]
    near = texts[4] + " z"
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[1].upper()), (7, texts[2]), (7, texts[3]), (7, texts[3]),
            (3, texts[4]), (9, near), (9, texts[5]), (None, near), (5, None), (5, " "), (None, None), (5, None)]
    got = near_stage(spark, rows)
    assert got == Counter([(None, texts[0]), (None, min(texts[1], texts[1].upper())), (7, texts[2]), (7, texts[3]), (3, texts[4]),
                           (9, texts[5]), (5, None), (5, " "), (None, None), (5, None)])
    assert not near_stage(spark, [])
