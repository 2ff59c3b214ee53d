"""Tokenization automaton: the gadgets against an explicit construction, words against the public library."""

import itertools
import random
from array import array
from hashlib import sha256

import public_tokenizers
import pytest
import tokenizers

from choicefield.llm import automaton
from choicefield.llm.queries import QUERIES
from tests.conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


def merged(symbols, merges):
    """Plain BPE: each merge in order, from the left."""
    out = list(symbols)
    for a, b, ab in merges:
        i = 0
        while i + 1 < len(out):
            if out[i] == a and out[i + 1] == b:
                out[i:i + 2] = [ab]
            i += 1
    return out


def random_merges(rng, base, n):
    have, out = list(base), []
    for _ in range(n):
        a, b = rng.choice(have), rng.choice(have)
        if a + b not in have:
            have.append(a + b)
            out.append((a, b, a + b))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_paths_are_the_encodings(seed):
    rng = random.Random(seed)
    merges = random_merges(rng, "ab", 7)
    auto = automaton.Automaton("ab", merges)
    tokens = ["a", "b", *[ab for _, _, ab in merges]]
    for n in (1, 2, 3):
        for path in itertools.product(tokens, repeat=n):
            state, good = 0, True
            for t in path:
                good = good and auto.follows(state, t)
                state = auto.to[t]
            assert good == (merged("".join(path), merges) == list(path)), (merges, path)
    words = automaton.Transducer(auto, {t: t for t in tokens})
    for n in range(1, 11):
        for word in itertools.product("ab", repeat=n):
            assert words.encode("".join(word)) == merged(word, merges)


def test_two_ways_to_a_token_are_refused():
    with pytest.raises(ValueError):
        automaton.Automaton("abc", [("a", "b", "ab"), ("ab", "c", "abc"), ("b", "c", "bc"), ("a", "bc", "abc")])


def texts():
    rng = random.Random(7)
    letters = list("abnithes'1 .,!") + ["é", "ß", "中", "İ", "Σ", "\x1c", "　", "̈", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>"]
    out = ["", " \n", "don't WE'LL ΌΔΟΣ", "x" * 70_000, "the" * 3000, "<|endoftext|><|endoftext|> a<|startoftext|>b", "ÅÅ ﬁ 가 각 ٣٤"]
    out += ["".join(rng.choices(letters, k=rng.randint(1, 50))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2ff), rng.randint(1, 0xd7ff), rng.randint(0xe000, 0x1ffff)])) for _ in range(20)) for _ in range(800)]
    return out


def test_same_as_the_public_library(spark, monkeypatch):
    public = tokenizers.Tokenizer.from_file(PATH)
    cases = texts()
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(cases)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r for r in automaton.encode_decode(rows, PATH, whole=True).collect()}
    for i, e in enumerate(public.encode_batch(cases, add_special_tokens=False)):
        assert (got[i].ids, got[i].decoded) == (e.ids, public.decode(e.ids, skip_special_tokens=False)), cases[i]
        assert got[i].ids_sha256 == sha256(array("I", e.ids).tobytes()).hexdigest()
    monkeypatch.setattr(automaton, "STATES", 50)
    small = automaton.Words(PATH)
    for text in cases[:400]:
        (code, _), = small.texts([text])
        assert list(memoryview(code).cast("I")) == public.encode(text, add_special_tokens=False).ids


def test_nulls_repeated_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "a b")], "doc_id bigint, text string")
    got = sorted(automaton.encode_decode(rows, PATH).collect(), key=str)
    assert [r.n_tokens for r in got] == [0, 0, 2, 2]
    assert got[0].ids_sha256 == got[0].decoded_sha256 == sha256(b"").hexdigest()
    assert automaton.encode_decode(rows.limit(0), PATH).count() == 0


def test_query_on_the_whole_table(spark):
    public = tokenizers.Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in QUERIES["op13_tokenization_automaton"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, e in zip(docs, public.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        decoded = public.decode(e.ids, skip_special_tokens=False)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (
            len(e.ids), sha256(array("I", e.ids).tobytes()).hexdigest(), sha256(decoded.encode()).hexdigest())
