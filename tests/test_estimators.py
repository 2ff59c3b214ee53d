import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from choicefield.estimators import choice, latent, linear, pipeline, simulated
from choicefield.functions import groups
from choicefield.operators import kernels, measurement, paths, resample, stats, utility
from choicefield.operators.stats import cov_sufficient_stats


def choices(n=400, sets=6, alts=3, beta=(0.8, -0.6), seed=42, sd=0.0):
    rng = np.random.default_rng(seed)
    i = np.repeat(np.arange(n), sets * alts)
    s = np.repeat(np.arange(n * sets), alts)
    x = rng.normal(size=(len(i), 2))
    b = np.array(beta) + np.array([sd, 0]) * rng.normal(size=(n, 1))
    u = (x * b[i]).sum(1) + rng.gumbel(size=len(i))
    best = u.reshape(-1, alts).argmax(1)
    y = (np.tile(np.arange(alts), n * sets) == np.repeat(best, alts)).astype(int)
    return pd.DataFrame({"id": i, "sid": s, "alt": np.tile(np.arange(alts), n * sets), "x1": x[:, 0], "x2": x[:, 1], "chosen": y})


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame(choices()).cache()


def numpy_ll(pdf, b):
    v = pdf["x1"].to_numpy() * b[0] + pdf["x2"].to_numpy() * b[1]
    v = v.reshape(-1, 3)
    p = np.exp(v - v.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return np.log(p[pdf["chosen"].to_numpy().reshape(-1, 3) == 1]).sum()


def test_mnl_recovers_and_gradient_vanishes(spark, long):
    fit = choice.fit_mnl(long, ["sid"], ["x1", "x2"], key="id", robust=True)
    assert fit.converged and np.abs(fit.theta - [0.8, -0.6]).max() < 0.1
    assert np.abs(fit.point.gradient).max() < 1e-3
    assert fit.point.ll == pytest.approx(numpy_ll(choices(), fit.theta), abs=1e-6)
    assert fit.null_ll == pytest.approx(-2400 * np.log(3))
    hess = np.sqrt(np.diag(np.linalg.inv(fit.point.information)))
    assert np.allclose(fit.std_errors(), hess, rtol=0.3)  # robust and model-based agree on a correct model
    assert {r.parameter for r in fit.coefficients(spark).collect()} == {"x1", "x2"}


def test_scores_against_central_differences(long):
    rel = kernels.relative_design(long, ["sid"], ["x1", "x2"], "chosen", ["id"]).cache()
    b, h, pdf = np.array([0.3, 0.2]), 1e-5, choices()
    g = {r.parameter: r.gradient for r in kernels.mnl_gradient(rel, ["sid"], {"x1": 0.3, "x2": 0.2}).collect()}
    num = [(numpy_ll(pdf, b + h * e) - numpy_ll(pdf, b - h * e)) / (2 * h) for e in np.eye(2)]
    assert [g["x1"], g["x2"]] == pytest.approx(num, rel=1e-6)
    hess = {(r.row, r.col): r.value for r in kernels.hessian_agg(rel, ["sid"], {"x1": 0.3, "x2": 0.2}).collect()}
    up = {r.parameter: r.gradient for r in kernels.mnl_gradient(rel, ["sid"], {"x1": 0.3 + 1e-4, "x2": 0.2}).collect()}
    assert hess[("x1", "x1")] == pytest.approx((up["x1"] - g["x1"]) / 1e-4, rel=1e-3)


@pytest.mark.parametrize("parts", [1, 16])
def test_partitioning_does_not_matter(long, parts):
    rel = kernels.relative_design(long.repartition(parts), ["sid"], ["x1", "x2"], "chosen")
    assert kernels.set_scores(rel, ["sid"], {"x1": 0.8, "x2": -0.6}).agg(F.sum("ll")).first()[0] == pytest.approx(numpy_ll(choices(), [0.8, -0.6]))


def test_single_alternative_set_and_extreme_utilities(spark):
    df = spark.createDataFrame([(1, 1, 2000.0, 1), (2, 1, 0.0, 1), (2, 2, 2000.0, 0)], "sid int, alt int, x double, chosen int")
    rel = kernels.relative_design(df, ["sid"], ["x"], "chosen")
    out = {r.sid: r for r in kernels.set_scores(rel, ["sid"], {"x": 1.0}).collect()}
    assert out[1].ll == pytest.approx(np.log(1 - 1e-10)) and out[2].ll == pytest.approx(np.log(1e-10))
    assert np.isfinite(out[2].g_x)
    p = {(r.sid, r.alt): r.prob for r in utility.softmax_prob(df, ["sid"], "x").collect()}
    assert p[(1, 1)] == 1.0 and p[(2, 2)] == 1.0


def test_binary_and_ordered_probit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    eta = rng.normal(size=3000)
    pdf = pd.DataFrame({"x": x, "y": (0.3 + 0.7 * x + rng.normal(size=3000) > 0).astype(int), "eta": eta,
                        "q": 1 + np.searchsorted([-1.0, -0.2, 0.4, 1.1], 0.9 * eta + rng.normal(size=3000))})
    df = spark.createDataFrame(pdf)
    fit = choice.fit_binary_probit(df, ["x"], "y")
    assert np.abs(fit.theta - [0.3, 0.7]).max() < 0.12 and np.abs(fit.point.gradient).max() < 0.05
    op = choice.fit_ordered_probit(df, "eta", ["q"])["q"]
    assert np.abs(op.theta - [0.9, -1.0, -0.2, 0.4, 1.1]).max() < 0.15 and op.converged
    cats = df.limit(20).withColumns({f"c{k}": F.lit(k) for k in range(1, 6)})
    probs = measurement.ordered_probit_prob(cats, "eta", {f"c{k}": (0.9, [-1.0, -0.2, 0.4, 1.1]) for k in range(1, 6)})
    total = probs.select(sum((F.col(f"p_c{k}") for k in range(2, 6)), F.col("p_c1")).alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-6 for r in total)


class Done(Exception):
    pass


def at_start(monkeypatch, fit, probe):
    """Run ``probe(names, start, evaluate)`` where the optimiser would start."""
    seen = {}

    def stop(names, start, evaluate, *args, **kwargs):
        seen["out"] = probe(names, np.asarray(start, dtype=float), evaluate)
        raise Done
    monkeypatch.setattr(simulated, "maximise", stop)
    with pytest.raises(Done):
        fit()
    return seen["out"]


def gradient_errors(names, start, evaluate):
    theta = start + 0.07
    here = evaluate(dict(zip(names, theta)))
    for k in range(len(names)):
        step = np.eye(len(names))[k] * 1e-4
        num = (evaluate(dict(zip(names, theta + step))).ll - evaluate(dict(zip(names, theta - step))).ll) / 2e-4
        assert here.gradient[k] == pytest.approx(num, rel=1e-4, abs=1e-3), names[k]
    return here


def test_random_parameter_logit_scores_and_salting(spark, monkeypatch):
    df = spark.createDataFrame(choices(n=30, sets=4, sd=0.8, seed=3))
    fit = lambda: simulated.fit_rpl(df, "id", ["sid"], ["x1", "x2"], ["x1"], n_draws=8)
    plain = at_start(monkeypatch, fit, gradient_errors)
    monkeypatch.setattr(groups, "HOT_ROWS", 5)
    salted = at_start(monkeypatch, fit, lambda n, s, e: e(dict(zip(n, s + 0.07))))
    assert salted.ll == pytest.approx(plain.ll) and np.allclose(salted.gradient, plain.gradient)


def iclv_data(n=30, seed=4):
    pdf = choices(n=n, sets=3, seed=seed)
    rng = np.random.default_rng(seed)
    wealth = rng.normal(size=n)
    eta = 0.7 * wealth + rng.normal(size=n)
    ind = pd.DataFrame({"id": np.arange(n), "wealth": wealth, "i1": 0.9 * eta + rng.normal(size=n), "i2": 0.6 * eta + rng.normal(size=n)})
    ind.loc[0, "i1"] = None
    return pdf, ind


def test_joint_model_scores_and_salting(spark, monkeypatch):
    pdf, ind = iclv_data()
    df = spark.createDataFrame(pdf)
    who = spark.createDataFrame(ind.astype({"id": "int64"})).withColumn("i1", F.when(~F.isnan("i1"), F.col("i1")))
    fit = lambda: simulated.fit_iclv_simultaneous(df, who, "id", ["sid"], ["x1"], "x2", ["i1", "i2"], ["wealth"], n_draws=6)
    plain = at_start(monkeypatch, fit, gradient_errors)
    monkeypatch.setattr(groups, "HOT_ROWS", 5)
    salted = at_start(monkeypatch, fit, lambda n, s, e: e(dict(zip(n, s + 0.07))))
    assert salted.ll == pytest.approx(plain.ll) and np.allclose(salted.gradient, plain.gradient)


def test_linear_and_penalised_logit(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=500), "b": rng.normal(size=500)})
    pdf["y"] = 1 + 2 * pdf.a - pdf.b + rng.normal(size=500)
    pdf["z"] = (pdf.a + rng.logistic(size=500) > 0).astype(int)
    df = spark.createDataFrame(pdf)
    est = {r.parameter: r.estimate for r in linear.ols(df, "y", ["a", "b"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(500), pdf.a, pdf.b]), pdf.y, rcond=None)[0]
    assert [est["const"], est["a"], est["b"]] == pytest.approx(want)
    plain, scaled = choice.fit_logit(df, ["a", "b"], "z"), choice.fit_logit(df, ["a", "b"], "z", standardise=True)
    assert np.allclose(plain.theta, scaled.theta, atol=1e-5) and np.allclose(plain.std_errors(), scaled.std_errors(), rtol=1e-4)
    assert abs(choice.fit_logit(df, ["a"], "z", l2=1000.0).theta[1]) < abs(plain.theta[1])
    assert linear.vif(df.withColumn("c", F.col("a")), ["a", "c"]).first().vif == float("inf")


def factor_data(n=800, seed=5):
    rng = np.random.default_rng(seed)
    f = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], n)
    load = {"a1": (0, 1.0), "a2": (0, 0.8), "a3": (0, 0.6), "b1": (1, 1.0), "b2": (1, 0.9), "b3": (1, 0.7)}
    return pd.DataFrame({"id": np.arange(n), **{k: l * f[:, j] + 0.6 * rng.normal(size=n) for k, (j, l) in load.items()}})


FACTORS = {"A": ["a1", "a2", "a3"], "B": ["b1", "b2", "b3"]}


def test_factor_model_recovers(spark):
    df = spark.createDataFrame(factor_data())
    fits = latent.multi_factor_fit(df, FACTORS).cache()
    lam = {r.lval: r.estimate for r in latent.sem_params(fits, [i for c in FACTORS.values() for i in c]).filter("part = 'loading'").collect()}
    assert lam["a2"] == pytest.approx(0.8, abs=0.1) and lam["b3"] == pytest.approx(0.7, abs=0.1)
    idx = latent.fit_indices(fits).first()
    assert idx.df == 8 and idx.p_value > 0.01 and idx.cfi > 0.98 and idx.converged == 1.0
    params = latent.sem_params(fits, [i for c in FACTORS.values() for i in c]).filter("part in ('variance', 'covariance')")
    assert latent.factor_corr_model(params).first().r == pytest.approx(0.5, abs=0.1)
    path = latent.sem_fit(df, FACTORS, [("B", "A")]).filter("op = '~' and lval = 'B'").first()
    assert path.std_estimate == pytest.approx(0.5, abs=0.1) and path.p_value < 1e-6


def test_two_stage_pipeline(spark, long):
    rng = np.random.default_rng(9)
    items = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), **{k: rng.normal(size=400) for k in ("a1", "a2", "a3")}}).assign(
        a2=lambda d: d.a1 * 0.8 + 0.5 * d.a2, a3=lambda d: d.a1 * 0.7 + 0.5 * d.a3))
    s = pipeline.stage1_scores(items, "id", {"A": ["a1", "a2", "a3"]})
    m = s.agg(F.avg("A").alias("m"), F.stddev_pop("A").alias("s")).first()
    assert m.m == pytest.approx(0, abs=1e-10) and m.s == pytest.approx(1)
    grid = pipeline.run_model_grid(long, s, "id", ["sid"], ["x1", "x2"], {"base": {}, "inter": {"interactions": [("A", "x1")]}})
    ll = {r.run: r.estimate for r in grid.filter("parameter = 'LL'").collect()}
    assert ll["inter"] >= ll["base"]


def test_weights_and_replicates(spark, long):
    w = resample.bootstrap_individuals(long.select("id"), "id", 8, 1).cache()
    assert [r[0] for r in w.groupBy("replicate").agg(F.sum("w")).select("sum(w)").collect()] == [400] * 8
    rel = kernels.relative_design(long, ["sid"], ["x1", "x2"], "chosen", ["id"])
    reps = resample.bootstrap_stage2(rel, "id", ["sid"], {"x1": 0.8, "x2": -0.6}, w).toPandas()
    assert reps["value"].notna().all()
    one = w.filter("replicate = 1").toPandas().set_index("id")["w"]
    pdf = choices()
    pdf["w"] = pdf["id"].map(one).fillna(0)
    v = reps[reps.replicate == 1].set_index("parameter")["value"]
    x = pdf[["x1", "x2"]].to_numpy()
    u = np.exp(x @ [v["x1"], v["x2"]]).reshape(-1, 3)
    p = (u / u.sum(1, keepdims=True)).ravel()
    assert np.abs(((pdf["chosen"] - p) * pdf["w"]).to_numpy() @ x).max() < 0.05


def test_parametric_bootstrap_centres_on_the_covariance(spark):
    df = spark.createDataFrame(factor_data())
    cov = cov_sufficient_stats(df, ["a1", "a2"])
    want = {(r.var1, r.var2): r.cov for r in cov.collect()}
    got = {(r.var1, r.var2): r.m for r in resample.bootstrap_parametric(cov, ["a1", "a2"], 200, 3).groupBy("var1", "var2").agg(F.avg("cov").alias("m")).collect()}
    assert all(got[k] == pytest.approx(want[k], rel=0.03) for k in want)


def test_weighted_covariance_equals_repeated_rows(spark):
    df = spark.createDataFrame(factor_data(60)).withColumn("w", F.col("id") % 3)
    once = {(r.var1, r.var2): r.cov for r in cov_sufficient_stats(df, ["a1", "b1"], weight="w").collect()}
    rows = df.withColumn("k", F.explode(F.when(F.col("w") > 0, F.sequence(F.lit(1), F.col("w")))))
    again = {(r.var1, r.var2): r.cov for r in cov_sufficient_stats(rows, ["a1", "b1"]).collect()}
    assert all(once[k] == pytest.approx(again[k]) for k in once)


def test_moderation_and_slopes(spark):
    rng = np.random.default_rng(2)
    x, m = rng.normal(size=600), rng.normal(size=600)
    y = 1 + 0.5 * x - 0.3 * m + 0.4 * x * m + rng.normal(size=600)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "m": m, "y": y}))
    fit = paths.moderation_fit(df, "x", "m", "y").cache()
    d = np.column_stack([np.ones(600), x, m, x * m])
    b = np.linalg.lstsq(d, y, rcond=None)[0]
    v = np.linalg.inv(d.T @ d) * ((y - d @ b) ** 2).sum() / 596
    est = {r.term: (r.estimate, r.std_err) for r in fit.collect()}
    assert est["xm"] == pytest.approx((b[3], v[3, 3] ** 0.5)) and paths.moderation_interpret(fit).first().effect == "strengthening"
    low = {r.level: r for r in paths.simple_slopes(fit).collect()}["low"]
    at = m.mean() - m.std(ddof=1)
    assert low.slope == pytest.approx(b[1] + b[3] * at)
    assert low.se == pytest.approx((v[1, 1] + 2 * at * v[1, 3] + at ** 2 * v[3, 3]) ** 0.5)
    assert paths.moderation_sweep(df, ["x", "m", "y"]).count() == 6


def test_procrustes_undoes_a_rotation(spark):
    a = 0.7
    ref = [("i1", 0.9, 0.1), ("i2", 0.8, 0.0), ("i3", 0.1, 0.7)]
    turned = [(1, i, x * np.cos(a) - y * np.sin(a), x * np.sin(a) + y * np.cos(a)) for i, x, y in ref]
    r = spark.createDataFrame(ref, "item string, f double, g double")
    t = spark.createDataFrame([(k, i, float(x), float(y)) for k, i, x, y in turned], "replicate int, item string, f double, g double")
    out = {x.item: (x.f, x.g) for x in resample.procrustes_align(r, t, ["replicate"], ["f", "g"]).collect()}
    assert all(out[i] == pytest.approx((x, y), abs=1e-9) for i, x, y in ref)


def test_registry_of_models(long):
    assert choice.create_model("mnl") is choice.fit_mnl
    with pytest.raises(ValueError):
        choice.create_model("nested")
    choice.register_model("mine", lambda *a: None)
    assert "mine" in choice.MODELS
    assert stats.auc(long, "chosen", "x1").first().auc > 0.6


def test_ml_stages(spark):
    from pyspark.ml import Pipeline

    from choicefield.estimators.stages import FactorScorer, ZScore
    df = spark.createDataFrame(factor_data(300))
    model = Pipeline(stages=[FactorScorer(FACTORS), ZScore(["A", "B"])]).fit(df)
    out = model.transform(df).cache()
    assert out.agg(F.stddev_pop("A_z")).first()[0] == pytest.approx(1)
    back = model.stages[1].inverse_transform(out)
    assert back.agg(F.max(F.abs(F.col("A_back") - F.col("A")))).first()[0] < 1e-12
    s = pipeline.stage1_scores(df, "id", FACTORS).join(out.select("id", "A_z"), "id")
    assert s.agg(F.max(F.abs(F.col("A") - F.col("A_z")))).first()[0] < 1e-6
