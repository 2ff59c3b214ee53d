"""Byte-level BPE and packing."""

import base64
import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from choicefield.llm import bpe, packing, queries
from conftest import SMALL

PATH, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [(1, None, 0), (2, "", 0), (3, "x", 0), (3, "x", 0), (None, "two  spaces\n\n and <|endoftext|> ", 0), (6, "long " * 3000, 0), (7, "é" * 3000, 0), (8, "  a b \x1c c", 0)]


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_library(oracle):
    codec, chunks = bpe.ready(PATH, P.PATTERN)
    rng = random.Random(2)
    texts = ["".join(rng.choice("aaab tthe\n\n  éü漢字9'sll.…😀") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 3000, "ab" * 2000, "the" * 900, "=" * 2000, "é" * 900, "  x", "x  ", " x ", ""]
    for text, code in zip(texts, chunks.texts(texts)):
        want = oracle.encode_ordinary(text)
        assert np.frombuffer(code, "<u4").tolist() == want == np.frombuffer(codec.encode(text), "<u4").tolist()
        assert codec.decode(want) == text.encode()


def test_joining_is_associative(oracle):
    codec, _ = bpe.ready(PATH, P.PATTERN)
    rng = random.Random(4)
    for _ in range(500):
        x, y, z = ["".join(rng.choice("abtheing") for _ in range(rng.randint(1, 14))).encode() for _ in range(3)]
        a, b, c = map(codec.merged, (x, y, z))
        assert codec.join(codec.join(a, b), c) == codec.join(a, codec.join(b, c)) == codec.merged(x + y + z)


def test_query_and_odd_rows(spark, oracle):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op6_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    odd = bpe.encode_decode(spark.createDataFrame(ODD, "doc_id long, text string, ids long"), PATH, P.PATTERN, whole=True).collect()
    assert len(odd) == len(ODD)
    for r, text in [(r, texts[r.doc_id]) for r in rows] + [(r, dict((a, b) for a, b, _ in ODD)[r.doc_id] or "") for r in odd]:
        ids = oracle.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(text.encode()).hexdigest()


def check_packed(rows, texts, capacity=1024):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    ids = {k: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for k, t in texts.items()}
    for r in rows:
        assert r.ids_crc32 == crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) and 0 < r.length <= capacity
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return ids, len(sequences)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op9_packing(spark, SMALL).collect()
    ids, sequences = check_packed(rows, texts)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert pieces.keys() == ids.keys()
    for k, parts in pieces.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for *_, n in parts) == len(ids[k])
        assert all(s == sum(n for *_, n in parts[:i]) for i, (_, s, _) in enumerate(parts)) and all(n == 1024 for *_, n in parts[1:])
    assert sequences <= -(-sum(map(len, ids.values())) // 1024) * 1.02 + 1


def test_packing_odd_rows(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string, piece int")
    rows = packing.pack(frame, JSON).collect()
    check_packed(rows, {a: b for a, b, _ in ODD})
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(a for a, *_ in ODD)
    assert packing.pack(frame.limit(0), JSON).count() == 0


def test_plan_places_each_piece_once():
    rng = random.Random(8)
    for _ in range(40):
        counts = {rng.randint(1, 63): rng.randint(1, 9) for _ in range(rng.randint(0, 30))}
        rows, sequences = packing.plan(counts, 64)
        taken = {}
        for x, lo, hi, first, offset in rows:
            assert offset + x <= 64
            taken.setdefault(x, []).append((lo, hi))
        for x, c in counts.items():
            assert sorted(taken[x]) and [i for lo, hi in sorted(taken[x]) for i in range(lo, hi)] == list(range(c))
        assert sequences >= -(-sum(x * c for x, c in counts.items()) // 64)
    assert packing.plan({512: 4, 300: 2, 724: 2, 100: 3, 400: 3, 524: 3})[1] == 2 + 2 + 3
