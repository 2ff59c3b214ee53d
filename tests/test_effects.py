"""Least squares from moments, moderation with controls, mediation intervals, scrambled draws, late gains."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from choicefield.estimators import linear
from choicefield.functions import vector
from choicefield.operators import iterations, kernels, leastsq, measurement, mediation, paths, resample


def sample(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x, w1, w2, w3 = rng.normal(size=(4, n)) + [[1], [0], [2], [0]]
    m = 0.5 * x + rng.normal(size=n)
    y = 1 + 0.4 * x - 0.3 * m + 0.25 * x * m + 0.6 * w1 - 0.2 * w2 + rng.normal(size=n)
    return pd.DataFrame({"id": np.arange(n), "x": x, "m": m, "y": y, "w1": w1, "w2": w2, "w3": w3, "g": np.arange(n) % 3})


def numpy_fit(pdf, controls, centre=False):
    x, m = (pdf[c] - (pdf[c].mean() if centre else 0) for c in ("x", "m"))
    full = np.column_stack([np.ones(len(pdf)), x, m, x * m, *[pdf[c] for c in controls]])
    b, _, rank, _ = np.linalg.lstsq(full, pdf.y, rcond=None)
    s2 = ((pdf.y - full @ b) ** 2).sum() / (len(pdf) - rank)
    return b, np.sqrt(np.diag(s2 * np.linalg.pinv(full.T @ full)))


@pytest.mark.parametrize("centre", [False, True])
@pytest.mark.parametrize("controls", [[], ["w1", "w2", "w3"]])
def test_moderation_with_controls(spark, controls, centre):
    pdf = sample()
    df = spark.createDataFrame(pdf)
    for keys, groups in (([], {(): pdf}), (["g"], {(g,): d for g, d in pdf.groupby("g")})):
        got = paths.moderation_fit(df, "x", "m", "y", keys, controls, centre).collect()
        for key, part in groups.items():
            rows = {r.term: r for r in got if tuple(r[k] for k in keys) == key}
            b, se = numpy_fit(part, controls, centre)
            names = ["c", "x", "m", "xm", *controls]
            assert [rows[t].estimate for t in names] == pytest.approx(b, rel=1e-7, abs=1e-9) and [rows[t].std_err for t in names] == pytest.approx(se, rel=1e-6)
            assert rows["x"].n == len(part)


def test_dependent_controls_and_few_rows(spark):
    pdf = sample(50)
    pdf["twice"] = 2 * pdf.w1
    got = {r.term: r.estimate for r in paths.moderation_fit(spark.createDataFrame(pdf), "x", "m", "y", controls=["w1", "twice"]).collect()}
    b, _ = numpy_fit(pdf, ["w1"])
    assert [got[t] for t in ("c", "x", "m", "xm")] == pytest.approx(b[:4], rel=1e-6)
    assert got["w1"] + 2 * got["twice"] == pytest.approx(b[4], rel=1e-6)
    few = paths.moderation_fit(spark.createDataFrame(pdf.head(3)), "x", "m", "y").collect()
    assert len(few) == 4 and all(r.std_err is None for r in few)
    assert paths.moderation_fit(spark.createDataFrame(pdf).filter("false"), "x", "m", "y").count() == 0
    sweep = paths.moderation_sweep(spark.createDataFrame(pdf), ["x", "m", "y"], ["w1"]).filter("x = 'x' and m = 'm'").first()
    assert sweep.estimate == pytest.approx(b[3], rel=1e-6)


def test_ols_of_many_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 40))
    y = x @ rng.normal(size=40) + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*[f"x{i}" for i in range(40)], "y"]))
    got = {r.parameter: r.estimate for r in linear.ols(df, "y", [f"x{i}" for i in range(40)]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert [got["const"], *[got[f"x{i}"] for i in range(40)]] == pytest.approx(want)
    assert leastsq.full_matrix([1, 2, 3, 4, 5, 6], 3).tolist() == [[1, 2, 3], [2, 4, 5], [3, 5, 6]]


def test_mediation_triples_equal_one_at_a_time(spark):
    pdf = sample(150).assign(const=1.0)
    cols = ["x", "m", "y", "w1"]
    df = spark.createDataFrame(pdf)
    weights = resample.bootstrap_individuals(df, "id", 6, 3)
    got = {(r.replicate, r.x, r.m, r.y): r for r in mediation.triple_effects(mediation.weighted_covariances(df, weights, "id", cols), cols).collect()}
    assert len(got) == 6 * 24
    drawn = {}
    for r in weights.collect():
        drawn.setdefault(r.replicate, []).extend([r.id] * r.w)
    for b, ids in drawn.items():
        d = pdf.loc[ids]
        for x, m, y in (("x", "m", "y"), ("w1", "y", "x")):
            a = np.polyfit(d[x], d[m], 1)[0]
            coefs = np.linalg.lstsq(np.column_stack([np.ones(len(d)), d[x], d[m]]), d[y], rcond=None)[0]
            r = got[b, x, m, y]
            assert (r.a, r.direct, r.b, r.indirect) == pytest.approx((a, coefs[1], coefs[2], a * coefs[2]))
            assert r.total == pytest.approx(r.direct + r.indirect)


def test_mediation_intervals_and_rate(spark):
    pdf = sample(300).assign(const=1.0)
    pdf.loc[0, "m"] = None
    out = mediation.mediation_bootstrap(spark.createDataFrame(pdf), "id", ["x", "m", "y", "const"], 40, 9)
    rows = {(r.x, r.m, r.y): r for r in out.collect()}
    assert len(rows) == 24
    flat = rows["const", "m", "y"]
    assert flat.estimate is None and not flat.significant and flat.n_failed == 40
    r = rows["x", "m", "y"]
    assert r.ci_low <= r.mean <= r.ci_high and r.n_failed == 0 and r.ci_low < r.estimate < r.ci_high
    rate = mediation.mediation_rate(out).first()
    assert rate.n_tested == 24 and rate.n_significant == sum(v.significant for v in rows.values()) and rate.rate == pytest.approx(rate.n_significant / 24)


def test_scrambled_draws(spark):
    ids = spark.range(200).withColumnRenamed("id", "idx").withColumn("id", F.col("idx") * 3)
    plain, moved = (kernels.halton_draws(ids, "id", 5, 3, scramble=s).orderBy("id", "r").toPandas() for s in (None, 4))
    index = np.arange(1000) + 1
    for d, base in enumerate((2, 3, 5)):
        for frame, seed in ((plain, None), (moved, 4)):
            u = vector.radical_inverse(index, base, 1000, seed)
            assert np.allclose(vector.norm_cdf(frame[f"z{d + 1}"].to_numpy()), u, atol=1e-9)
        assert abs(moved[f"z{d + 1}"].mean()) < 0.02 and abs(moved[f"z{d + 1}"].std() - 1) < 0.02
    assert np.abs(np.corrcoef(moved.z1, moved.z2)[0, 1]) < 0.1 and not np.allclose(plain.z1, moved.z1)


def test_many_rising_evaluations_are_folded_in_constant_memory(spark):
    n, patience = 300_000, 4
    df = spark.range(n).select(F.lit("run").alias("run"), F.col("id").alias("i"), (F.col("id") * 0.3).alias("ll"))
    # a gain every fourth step (0.3, 0.6, 0.9, 1.2): never five in a row without one, as long as the run lasts
    assert iterations.early_stop_point(df, "run", ["i"], "ll", patience=patience, tol=1.0).first().stopped is False
    row = iterations.early_stop_point(df, "run", ["i"], "ll", patience=3, tol=1.0).first()
    assert (row.stopped, row.stop_step, row.n_evaluations) == (True, 4, n)


def test_structural_equation_with_any_number_of_predictors(spark):
    pdf = sample(120)
    df = spark.createDataFrame(pdf)
    for xs in (["x"], ["x", "m"], ["x", "m", "w1", "w2"]):
        r = measurement.structural_ols(df, "y", xs).first()
        b, rss, *_ = np.linalg.lstsq(pdf[xs].to_numpy(), pdf.y.to_numpy(), rcond=None)
        assert [r[f"gamma_{x}"] for x in xs] == pytest.approx(b) and r.n == 120
        assert (r.sigma2, r.r2) == pytest.approx((rss[0] / (120 - len(xs)), 1 - rss[0] / (120 * pdf.y.var(ddof=0))))
    twice = measurement.structural_ols(df.withColumn("x2", F.col("x") * 2), "y", ["x", "x2"]).first()
    assert twice.gamma_x + 2 * twice.gamma_x2 == pytest.approx(measurement.structural_ols(df, "y", ["x"]).first().gamma_x)
    assert measurement.structural_ols(df.filter("false"), "y", ["x"]).count() == 0
