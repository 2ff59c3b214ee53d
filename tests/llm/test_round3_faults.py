"""Faults found in review: long roles, unreadable records, keys of neighbours, mirrored words, spoken signs, deep and unmatched markup."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from choicefield.llm import ann, chat, html, pii
from choicefield.llm.ngram_join import jaccard_components


def test_roles_of_any_length(spark):
    role = "a\\b:c" * 200_000
    rows = spark.createDataFrame([(1, 0, role, "hi"), (1, 1, "assistant", "x: y" * 200_000)], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_conversations(chat.records_of_turns(rows))).first()
    assert got.turns_sha256 == hashlib.sha256(f"{role}\nhi\nassistant\n{'x: y' * 200_000}\n".encode()).hexdigest() and got.n_turns == 2


def test_a_record_that_cannot_be_read_is_an_error(spark):
    rows = spark.createDataFrame([(1, '{"unknown": 1}')], "conv_id long, record string")
    with pytest.raises(Exception, match="no formatted string for 1"):
        chat.digests(chat.format_conversations(rows)).collect()


def test_vectors_whose_hashes_met(spark):
    rows = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 2.0]), (2, [24.0, -10830.305548832697])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in ann.search(rows, F.col("vec_id") == 0).collect()}
    assert got[1] == pytest.approx(-0.3162, abs=1e-3) and got[2] == pytest.approx(0.7087, abs=1e-3)


@pytest.mark.parametrize("doublings", [10, 12, 16])
def test_mirrored_words_are_unlike(spark, doublings):
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_components(rows).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("text,kind", [("call plus 49 170 1234567 now", "phone"), ("card 4111 dash 1111 dash 1111 dash 1111 ok", "card"),
                                       ("card 4111 hyphen 1111 hyphen 1111 hyphen 1111 ok", "card"), ("PLUS 49 170 1234567", "phone")])
def test_spoken_signs_alone(text, kind):
    spans = pii.added_spans(text, pii.base_spans(text))
    assert [s[0] for s in spans] == [kind]
    start, end = spans[0][1:]
    assert text[start:end].lower().startswith(("plus", "4111")) and text[start:end][-1].isdigit()


def test_deep_and_unmatched_markup_in_linear_time():
    start = time.time()
    assert html.main_text("<div>" * 200_000 + "some words here") == "some words here"
    html.main_text("<i>" * 200_000 + "</b>" * 200_000 + "x")
    html.main_text("<b><table>" + "<i>" * 100_000 + "</b>" * 100_000 + "x")
    assert time.time() - start < 60
