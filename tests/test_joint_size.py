"""The joint model's step: what it reads, and its sums by blocks against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicefield.estimators import joint
from choicefield.functions import vector


@pytest.mark.parametrize("n", [1, 31, 32, 33, 200])
def test_grouped_sums(n):
    rng = np.random.default_rng(n)
    of = np.sort(rng.integers(0, max(2, n // 3), n))
    of[: n // 2] = of[0]  # a run over several blocks
    of = np.sort(of)
    x, weights = rng.normal(size=(n, 3)), rng.normal(size=(2, n))
    want = np.zeros((max(2, n // 3) + 2, 2, 3))
    for i, k in enumerate(of):
        want[k] += weights[:, i, None] * x[i]
    assert np.allclose(joint.grouped(of, len(want), x, weights), want)
    assert not joint.grouped(of[:0], 3, x[:0], weights[:, :0]).any()


@pytest.mark.parametrize("scale", [0.5, 400.0])
def test_choice_part_of_a_step(monkeypatch, scale):
    """Sets of 1 to 9 rows, the chosen row at 0, in chunks that cut sets; exponents of one scale and of more."""
    monkeypatch.setattr(joint, "CHUNK", 35)
    rng = np.random.default_rng(3)
    model = joint.Model(["x", "z"], {"u": []}, [("u", "z")], [], 5, largest=40)
    theta = np.array([0.7, -0.4, 0.8]) * scale
    kernel, kinds, sids, idx, people, d = joint.Kernel(model, theta), [], [], [], [], []
    want, points = 0.0, np.arange(1, 6)
    for i in range(6):
        people.append(np.zeros(0))
        kinds.append(0), sids.append(0), idx.append(i)
        eta = vector.norm_ppf(np.clip(vector.radical_inverse(i * 5 + points, 2, 40), 1e-12, 1 - 1e-12))
        ll = np.zeros(5)
        for s in range(4):
            rows = rng.normal(size=(rng.integers(1, 10), 2))
            rows[0] = 0.0
            v = rows[:, :1] * theta[0] + rows[:, 1:] * (theta[1] + theta[2] * eta)
            top = v.max(axis=0)
            ll += np.clip(-np.log(np.exp(v - top).sum(axis=0)) - top, *joint.LOG_PROB)
            for row in rows:
                kinds.append(1), sids.append(s), idx.append(i), d.append(row)
        want += np.log(np.exp(ll - ll.max()).mean()) + ll.max()
    kernel.feed(np.array(idx), np.array(kinds), np.array(sids), np.zeros((6, 0)), np.array(d))
    kernel.finish()
    assert kernel.total[0] == pytest.approx(want) and kernel.total[1] == 6


def test_a_step_reads_whole_batches(spark):
    model = joint.Model(["x"], {"u": []}, [("u", "x")], [], 2)
    rel = spark.range(3000).select((F.col("id") % 100).alias("id"), F.col("id").alias("sid"), (F.col("id") / 100).alias("d_x"))
    who = spark.range(100).withColumn("idx", F.col("id"))
    rows = joint.placed(rel, who, "id", ["sid"], model, False)
    assert rows.columns == ["rows"] and rows.count() <= rows.rdd.getNumPartitions()
    assert sum(len(b) for b in joint._unpacked(rows.toArrow().to_batches())) == 3100
    model.largest = 200
    (ll, n, _, _), = joint.evaluate(rows, model, [np.array([0.0, 0.0])], False)
    assert n == 100 and ll == pytest.approx(np.log(1 - 1e-10) * 30 * 100)
    rows.unpersist()
