"""Blocks, the joint model with several latent variables and ordered items, sandwich errors."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from choicefield.estimators import choice, joint, newton, simulated
from choicefield.functions import groups, vector
from choicefield.operators import blocks, kernels
from test_estimators import at_start, choices, gradient_errors


def test_gram_of_many_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 202))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"g_{i}" for i in range(202)])).repartition(5)
    cols = [f"g_{i}" for i in range(202)]
    assert np.allclose(blocks.gram(df, cols), x.T @ x)
    table = {(r.row, r.col): r.value for r in kernels.opg_matrix(df, cols, sign=-1.0).collect()}
    assert len(table) == 202 * 203 / 2 and table["3", "200"] == pytest.approx(-(x[:, 3] @ x[:, 200]))
    few = {(r.row, r.col): r.value for r in kernels.opg_matrix(df, cols[:3]).collect()}
    many = {(r.row, r.col): r.value for r in blocks.gram_table(df, cols[:3], ["0", "1", "2"]).collect()}
    assert few.keys() == many.keys() and all(many[k] == pytest.approx(v) for k, v in few.items())


def test_gram_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, None)], "g_a double, g_b double")
    assert blocks.gram(df, ["g_a", "g_b"]).tolist() == [[17.0, 2.0], [2.0, 13.0]]
    assert [r.value for r in kernels.opg_matrix(df, ["g_a", "g_b"]).collect()] == [17.0, 2.0, 13.0]
    none = df.limit(0)
    assert not blocks.gram(none, ["g_a", "g_b"]).any()
    assert {r.value for r in blocks.gram_table(none, ["g_a", "g_b"], ["a", "b"]).collect()} == {None}


def test_normal_law_on_arrays():
    x = np.linspace(-30, 30, 2001)
    exact = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.allclose(vector.norm_cdf(x), exact, rtol=1e-9, atol=1e-15)
    p = np.concatenate((10.0 ** -np.arange(1, 15), np.linspace(0.01, 0.99, 99)))
    assert np.allclose(vector.norm_cdf(vector.norm_ppf(p)), p, rtol=1e-9)
    assert vector.interval_prob(np.array([8.0]), np.array([9.0]))[0] == pytest.approx(6.22e-16, rel=1e-2)


@pytest.mark.parametrize("base", [2, 3, 5, 7])
def test_halton_points(base):
    n = base ** 5
    for seed in (None, 1, 2):
        u = vector.radical_inverse(np.arange(n), base, n - 1, seed)
        cells = np.floor(u * n + 1e-6).astype(int)
        assert sorted(cells) == list(range(n))  # one point in every cell: digits are permuted, none is lost
        for m in (base, base ** 2, base ** 3):  # and any first points are spread as evenly
            assert set(np.bincount(np.floor(u[:m * base] * m + 1e-6).astype(int), minlength=m)) == {base}
    assert (vector.radical_inverse(np.arange(n), base, n - 1, 1) > 0).all()
    assert vector.radical_inverse(np.array([6]), 2, 6)[0] == 0.375


def two_levels(n, sets=4, seed=11, categories=5, every=7):
    """eta1 = 0.8 w + z, eta2 = 0.6 eta1 + z; ordered and Gaussian items; utilities with a main effect and an interaction."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=n)
    one = 0.8 * w + rng.normal(size=n)
    two = 0.6 * one + rng.normal(size=n)
    cut = np.array([-1.2, -0.3, 0.5, 1.4])[:categories - 1]
    ind = pd.DataFrame({"id": np.arange(n), "w": w})
    for name, eta, zeta in (("a1", one, 1.0), ("a2", one, 0.8), ("b1", two, 0.9), ("b2", two, 0.7)):
        ind[name] = 1.0 + np.searchsorted(cut, zeta * eta + rng.normal(size=n))
    for name, eta, zeta in (("a3", one, 0.9), ("b3", two, 1.1)):
        ind[name] = zeta * eta + 0.7 * rng.normal(size=n)
    i = np.repeat(np.arange(n), sets * 3)
    alt = np.tile(np.arange(3), n * sets)
    x, buy = rng.normal(size=len(i)), (alt > 0).astype(float)
    u = 0.7 * x + 0.5 * one[i] * buy - 0.4 * two[i] * x + rng.gumbel(size=len(i))
    best = np.repeat(u.reshape(-1, 3).argmax(1), 3)
    long = pd.DataFrame({"id": i, "sid": np.repeat(np.arange(n * sets), 3), "alt": alt, "x": x, "buy": buy, "chosen": (alt == best).astype(int)})
    ind.loc[::every, "a1"] = None
    ind.loc[1::every, "b3"] = None
    return long[long.id % every != 3], ind


GRAPH = {"B": ["A"], "A": ["w"]}
ITEMS = {"A": {"a1": "ordered", "a2": "ordered", "a3": "gaussian"}, "B": {"b1": "ordered", "b2": "ordered", "b3": "gaussian"}}
TERMS = [("A", "buy"), ("B", "x")]


def frames(spark, long, ind):
    who = spark.createDataFrame(ind)
    return spark.createDataFrame(long), who.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c not in ("id",) else F.col(c) for c in who.columns])


def test_joint_gradients_slices_and_salts(spark, monkeypatch):
    long, who = frames(spark, *two_levels(24, sets=3))
    fit = lambda: simulated.fit_joint(long, who, "id", ["sid"], ["x"], GRAPH, ITEMS, TERMS, n_draws=5, scramble=3)
    plain = at_start(monkeypatch, fit, gradient_errors)
    monkeypatch.setattr(joint, "SLICE", 10)  # two rows a slice: sets and individuals go on in the next
    one = lambda names, start, evaluate: evaluate(dict(zip(names, start + 0.07)))
    slices = at_start(monkeypatch, fit, one)
    monkeypatch.setattr(groups, "HOT_ROWS", 5)
    salted = at_start(monkeypatch, fit, one)
    for other in (slices, salted):
        assert other.ll == pytest.approx(plain.ll) and np.allclose(other.gradient, plain.gradient) and np.allclose(other.information, plain.information)


def test_joint_model_recovers(spark):
    long, who = frames(spark, *two_levels(1500))
    fit = simulated.fit_joint(long, who, "id", ["sid"], ["x"], GRAPH, ITEMS, TERMS, n_draws=100)
    assert fit.converged
    want = {"beta_x": 0.7, "lambda_A_buy": 0.5, "lambda_B_x": -0.4, "gamma_w_to_A": 0.8, "gamma_A_to_B": 0.6, "zeta_a1": 1.0, "zeta_a2": 0.8, "zeta_b1": 0.9,
            "zeta_a3": 0.9, "zeta_b3": 1.1, "sigma2_a3": 0.49, "sigma2_b3": 0.49, "tau_a1_1": -1.2, "tau_a1_2": -0.3, "tau_a1_3": 0.5, "tau_a1_4": 1.4, "tau_b2_4": 1.4}
    se = dict(zip(fit.names, fit.std_errors()))
    off = {n: abs(fit.params[n] - v) / se[n] for n, v in want.items()}
    assert max(off.values()) < 3.2 and np.mean([v < 2 for v in off.values()]) > 0.85, off
    assert {r.parameter for r in fit.coefficients(spark).collect()} == set(fit.names)


def test_categories_that_nobody_chose(spark):
    long, ind = two_levels(60)
    ind["a2"] = ind["a2"].map(lambda v: 4.0 if v == 3.0 else v)
    ind["b2"] = 2.0
    long, who = frames(spark, long, ind)
    items, _ = simulated.indicators(who, ITEMS)
    assert [i.cuts for i in items if i.name == "a2"] == [["tau_a2_1", "tau_a2_2", "tau_a2_4"]]
    fit = simulated.fit_joint(long, who, "id", ["sid"], ["x"], GRAPH, ITEMS, TERMS, n_draws=4, max_iter=3)
    assert "zeta_b2" not in fit.names and np.isfinite(fit.theta).all()
    cuts = [fit.params[f"tau_a1_{v}"] for v in (1, 2, 3, 4)]
    assert cuts == sorted(cuts)


def test_wrong_specifications(spark):
    long, who = frames(spark, *two_levels(10))
    with pytest.raises(ValueError, match="circle"):
        simulated.fit_joint(long, who, "id", ["sid"], ["x"], {"A": ["B"], "B": ["A"]}, ITEMS, TERMS)
    with pytest.raises(ValueError, match="unknown term"):
        simulated.fit_joint(long, who, "id", ["sid"], ["x"], GRAPH, ITEMS, [("C", "x")])
    with pytest.raises(ValueError, match="unknown kind"):
        simulated.fit_joint(long, who, "id", ["sid"], ["x"], GRAPH, {"A": {"a1": "poisson"}}, TERMS)


def test_sandwich_errors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 2))
    y = (0.3 + x @ [0.8, -0.5] + rng.logistic(size=800) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    fit = choice.fit_logit(df, ["a", "b"], "y", robust=True)
    full = np.column_stack([np.ones(800), x])
    p = 1 / (1 + np.exp(-full @ fit.theta))
    h, b = (full * (p * (1 - p))[:, None]).T @ full, (full * ((y - p) ** 2)[:, None]).T @ full
    assert np.allclose(fit.robust, np.linalg.inv(h) @ b @ np.linalg.inv(h), rtol=1e-6)
    data, names = choice._with_const(df, ["a", "b"], "y")
    points = lambda thetas: [q for q, _ in choice._binary_points(data, names, choice._logit_link, thetas)]
    assert np.allclose(newton.numeric_information(points, fit.theta), h, rtol=1e-6)
    probit = choice.fit_binary_probit(df, ["a", "b"], "y", robust=True)
    assert np.allclose(probit.std_errors(), np.sqrt(np.diag(newton.inverse(probit.point.information))), rtol=0.2)


def test_sandwich_of_simulated_models(spark):
    df = spark.createDataFrame(choices(n=300, sets=6, sd=0.8, seed=3))
    plain, robust = (simulated.fit_rpl(df, "id", ["sid"], ["x1", "x2"], ["x1"], n_draws=40, robust=r, scramble=5) for r in (False, True))
    assert plain.params == pytest.approx(robust.params, abs=1e-6)
    assert np.allclose(plain.std_errors(), robust.std_errors(), rtol=0.5) and not np.allclose(plain.std_errors(), robust.std_errors(), rtol=1e-3)
    assert abs(robust.params["sd_x1"]) == pytest.approx(0.8, abs=0.35)
