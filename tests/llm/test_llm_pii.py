import random
import sys
from hashlib import sha256
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from conftest import SMALL  # noqa: E402
from choicefield.llm import pii, queries  # noqa: E402


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("ab1.23@@+- ()%_é٣0459 ") for _ in range(rng.randint(0, 40)))
        assert brute.base_spans(text) == pii.base_spans(text)


@pytest.mark.parametrize("text, kind, span", [
    ("mail bob (at) example (dot) com now", "email", "bob (at) example (dot) com"),
    ("bob[at]ex-ample[dot]co[dot]uk", "email", "bob[at]ex-ample[dot]co[dot]uk"),
    ("write to john.doe at example dot org", "email", "john.doe at example dot org"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("t​est@ex​ample.com", "email", "t​est@ex​ample.com"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("call +1 five five five 123 4567", "phone", "+1 five five five 123 4567"),
    ("card ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("ip 10 dot 0 dot 0 dot 1 up", "ip", "10 dot 0 dot 0 dot 1"),
    ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("null eins zwei drei", None, None), ("at one point the two of them", None, None), ("look at example.com", None, None),
    ("+1 (389) 555-4387 un deux", None, None)])
def test_disguises(text, kind, span):
    added = [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text))]
    assert added == ([(kind, span)] if kind else [])


def test_query_against_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op5_pii(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute.base_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda s: (s[1], pii.KINDS.index(s[0]))))
        assert r.base_sha256 == sha256(line.encode()).hexdigest() and set(filter(None, line.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.co " * 2, "x"), (3, "a@b.co " * 2, "x"), (None, "+1234567890", "x"), (5, "1" * 50000 + "@" * 20000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.find_pii(frame).collect()}
    assert out[1].spans == out[2].spans == "" and out[1].base_sha256 == sha256(b"").hexdigest()
    assert out[3].spans == "email:0:6,email:7:13" and out[None].n_phone == 1 and out[5].spans == ""
    assert pii.find_pii(frame.limit(0)).count() == 0
    clean = pii.redact(spark.createDataFrame([(1, "to a@b.co!", 10), (2, None, None)], "id int, text string, n long"), "text", "n").collect()
    assert sorted(map(tuple, clean), key=str) == [(1, "to [EMAIL]!", 11), (2, None, None)]
