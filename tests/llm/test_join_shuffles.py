"""The n-gram join: what its shuffles carry, and that filters before them lose nothing."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from choicefield.llm import common, ngram_join, shingles  # noqa: E402


def test_a_family_makes_a_few_rows_a_member(spark):
    """Members of one family share all their tokens; each meets a centre a few times and not once a token."""
    rows = [(t, bytes([n]), 60, t, 50, bytes([n])) for t in range(50) for n in range(50)]
    groups = spark.createDataFrame(rows, "token long, node binary, n long, pos int, m long, root binary")
    pairs = common.centre_pairs(groups, 0, lambda a, b: F.lit(True), None)
    assert pairs.count() == 49
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "early#" in plan and f"<= {common.FIRST})" in plan


def test_sketches_drop_only_what_cannot_link():
    rng = random.Random(2)
    sets = [np.unique(shingles.mix(np.array(rng.sample(range(900), rng.randrange(1, 700)), np.uint64))) for _ in range(60)]
    sets += [s[rng.randrange(max(1, len(s) // 12)):] for s in sets]
    a, b = zip(*[(i, j) for i in range(len(sets)) for j in range(i)])
    batch = pa.RecordBatch.from_pydict({"a": [bytes([i]) for i in a], "b": [bytes([j]) for j in b],
                                        "x": [ngram_join._sketch(sets[i]) for i in a], "y": [ngram_join._sketch(sets[j]) for j in b]})
    kept = {(x[0], y[0]) for part in ngram_join._likely_rows(batch, 85) for x, y in zip(part["a"].to_pylist(), part["b"].to_pylist())}
    linked = {(i, j) for i, j in zip(a, b) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= kept and len(kept) < len(a) / 4


@pytest.mark.parametrize("first", [4, 1])
def test_families_and_chains_match_brute_force(spark, monkeypatch, first):
    """Large families, one a chain whose ends are unlike, with a passage that all share."""
    monkeypatch.setattr(common, "SMALL", 3)
    monkeypatch.setattr(common, "FIRST", first)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(25)]
    rows, at = [], 0
    for family in range(3):
        text = [f"f{family}_{i}" for i in range(70)] + passage
        for _ in range(25):
            rows.append((at, " ".join(text)))
            at += 1
            text = list(text) if family else text
            text[rng.randrange(70)] = f"e{rng.randrange(400)}"
    rows += [(None, rows[3][1]), (7, rows[40][1]), (None, rows[60][1] + " more"), (900, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(frame).collect()), key=str) == brute.components(rows)


def test_only_shared_tokens_leave_their_node(spark):
    """Tokens of one node are not shuffled with it."""
    lists = [[1 << 40 | 5, 7 << 33 | 9], [11 << 35 | 3, 7 << 33 | 9]]
    frame = spark.createDataFrame([(b"a", 2, lists[0]), (b"b", 2, lists[1])], "node binary, n long, prefix array<long>")
    several = spark.createDataFrame([(7 << 33 | 9,)], "token long")
    picks = common.bit_filter(several, "token", mixed=True)
    rows = common.arrow_map(frame, ngram_join._shared_rows, "token bigint, node binary, pos int, n bigint", picks).collect()
    assert sorted((r.token, bytes(r.node), r.pos, r.n) for r in rows) == [(7 << 33 | 9, b"a", 1, 2), (7 << 33 | 9, b"b", 1, 2)]


@pytest.mark.parametrize("listed", [32, 3])
def test_last_pairs_are_those_that_may_link_made_once(spark, monkeypatch, listed):
    """A family whose members share most of their prefixes: its pairs are made once and not at each token, and none that bounds allow is lost."""
    monkeypatch.setattr(common, "LISTED", listed)
    rng = random.Random(5)
    rows, elsewhere = [], []
    for node in range(60):
        own = rng.randrange(10)  # tokens of this node alone come first
        held = sorted(rng.sample(range(14), 11))
        n = rng.choice([60, 64, 70])
        rows += [(t, bytes([node]), n, own + k, bytes([node % 45])) for k, t in enumerate(held)]
        if node % 3:
            elsewhere.append((bytes([node]), node % 4))
    groups = spark.createDataFrame(rows, "token long, node binary, n long, pos int, root binary").repartition(2)
    others = spark.createDataFrame(elsewhere, "node binary, o long")

    def alike(one, other):
        return 100 * F.least(one, other) >= 85 * F.greatest(one, other)

    def able(overlap, one, other):
        return 100 * overlap >= 85 * (F.col(one) + F.col(other) - overlap)

    def rest(n):
        return F.ceil(85 * F.col(n) / 100) - 1

    wanted = {(bytes(r.a), bytes(r.b)) for r in common.possible(common.open_pairs(groups, alike), others, able, rest).collect()}
    found = common.last_pairs(groups, others, alike, able, rest)
    pairs = [(bytes(r.a), bytes(r.b)) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and wanted <= set(pairs) and wanted
    every = common.open_pairs(groups, alike).count()
    if listed == 32:
        assert set(pairs) == wanted and len(wanted) < every
    join = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, ")[1].splitlines()[0]
    assert "array_intersect" in join and "root" in join
    plain = common.last_pairs(groups, others, lambda a, b: F.lit(True), None, None)
    assert {(bytes(r.a), bytes(r.b)) for r in plain.collect()} == {(bytes(r.a), bytes(r.b)) for r in common.open_pairs(groups, lambda a, b: F.lit(True)).collect()}


def test_sketches_are_bytes_unless_a_count_needs_more():
    few, many = np.arange(900, dtype=np.uint64) << np.uint64(40), np.arange(400, dtype=np.uint64)
    assert len(ngram_join._sketch(few)) == ngram_join.BUCKETS and len(ngram_join._sketch(many)) == 4 * ngram_join.BUCKETS
    counts = ngram_join._counts([ngram_join._sketch(few), ngram_join._sketch(many)])
    assert counts.sum(axis=1).tolist() == [900, 400] and counts[1].max() == 400
