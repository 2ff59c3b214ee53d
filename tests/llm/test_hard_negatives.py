"""Hard negatives against brute force over all pairs, the SQL, and odd rows."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from choicefield.llm import hard_negatives as op
from choicefield.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, every=4):
    """``rows`` are (vec_id, vector, label); anchors have ids divisible by ``every``."""
    good = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, label, tuple(math.floor(256 * x) for x in v)] = True
    good = list(good)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in good:
        if i % every == 0:
            scored = sorted((-dot(v, w), j, other) for j, other, w in good if (j != i or other != label))
            positives = [(j, -s) for s, j, other in scored if other == label and j != i][:5]
            for j, p in positives:
                bad = [(k, -s) for s, k, other in scored if other != label and 80 * p <= -100 * s <= 100 * p][:5]
                out += [(i, j, r + 1, k, p, n) for r, (k, n) in enumerate(bad)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def mined(spark, rows, every=4):
    return got(op.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0))


@pytest.mark.parametrize("seed", range(4))
def test_same_as_all_pairs(spark, monkeypatch, seed):
    """Several chunks, blocks and buckets; lengths over four orders of magnitude, many ties and copies."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(op, "CHUNK", 60)
    monkeypatch.setattr(op, "BLOCK", 20)
    monkeypatch.setattr(op, "BUCKET", 25)
    monkeypatch.setattr(op, "LEAST", 3)
    monkeypatch.setattr(op, "TRIED", 6)
    n, d = 260, (3, 6, 12, 2)[seed]
    vectors = rng.normal(size=(n, d)) * 10 ** rng.uniform(-2, 2, size=(n, 1)) if seed % 2 else np.round(rng.normal(size=(n, d)) + 0.5, 1)
    vectors[rng.random(n) < 0.25] = vectors[0]
    vectors[5:9] = 0
    rows = [(int(i), v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_pruning_skips_rows(monkeypatch):
    """The ranges leave few rows to score, and none that counts is lost."""
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(4000, 8)))
    scored = []
    plain = op.scores
    monkeypatch.setattr(op, "scores", lambda r, a: scored.append(len(r)) or plain(r, a))
    index, ids, length = op.buckets(rows), np.arange(4000), op.lengths(rows)
    for i in range(40):
        best = op.Best(5, -np.inf, np.inf)
        op.search(index, rows[i], length[i], [best], ids, ids != i)
        exact = rows @ rows[i]
        exact[i] = -np.inf
        assert best.scores.tolist() == sorted(exact, reverse=True)[:5]
    assert sum(scored) < 0.35 * 40 * 4000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (4, [0.0, 0.0], 1), (8, [], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, [2.0, 1.0], 2), (2, [1.0, 2.0, 5.0], 2), (3, None, 1),
            (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (9, [1.0, 1.9], None), (None, [1.0, 2.0], 2), (10, [0.9, 2.0], 2), (12, [-1.0, -2.0], 2), (4, [1.0, 2.0], 3)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    large = [(0, [1e12, 3.0], 0), (1, [1.0, 1e3], 0), (2, [0.9, 1e5], 1), (3, [0.95, 7.0], 1)]
    assert mined(spark, large) == brute(large) != []
    assert op.scores(np.array([[2.0 ** 40, 1.0]]), np.array([2.0 ** 20, 1.0])).tolist() == [2 ** 60 + 1]
    with pytest.raises(OverflowError):
        op.scores(np.array([[2.0 ** 40]]), np.array([2.0 ** 30]))
    clash = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, chunk int")
    assert got(op.hard_negatives(clash, F.col("vec_id") % 4 == 0)) == brute(rows)


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    want = con.sql(ORACLE_SQL["op12_hard_negatives"])
    assert want.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in con.sql("SELECT vec_id, embedding, label FROM embeddings").fetchall()]
    assert sorted(want.fetchall()) == got(QUERIES["op12_hard_negatives"](spark, SMALL)) == brute(rows, 100)
