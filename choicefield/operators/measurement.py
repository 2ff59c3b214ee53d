"""Measurement and structural equations at given parameters: probabilities, log-likelihoods, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf, norm_pdf
from ..functions.scalars import PROB_FLOOR, add, clip_prob
from .leastsq import moments, solve, solved


# ---- ordered probit --------------------------------------------------------------------------------------

FAR = 40.0  # Phi(40) = 1 and Phi(-40) = 0 in double precision


def _cut(y: Column, taus: list[float], shift: int) -> Column:
    """tau_{y+shift}, with +-FAR beyond the ends."""
    out = F.when(y + shift < 1, -FAR)
    for k, t in enumerate(taus, start=1):
        out = out.when(y + shift == k, F.lit(float(t)))
    return out.otherwise(FAR)


def ordered_probit_prob(df: DataFrame, eta: str, items: dict[str, tuple[float, list[float]]], floor: float = PROB_FLOOR) -> DataFrame:
    """Adds p_<item> = P(Y = y), clipped, NULL for a NULL answer. items: item -> (zeta, K-1 thresholds).

    Arguments, distribution values and probabilities are separate projections, so each is computed once.
    """
    args, phis, probs = {}, {}, {}
    for i, (z, taus) in items.items():
        for side, shift in (("u", 0), ("l", -1)):
            args[f"__{side}_{i}"] = _cut(F.col(i), taus, shift) - F.lit(float(z)) * F.col(eta)
            phis[f"__P{side}_{i}"] = norm_cdf(F.col(f"__{side}_{i}"))
        probs[f"p_{i}"] = F.when(F.col(i).isNotNull(), clip_prob(F.col(f"__Pu_{i}") - F.col(f"__Pl_{i}"), floor))
    return df.withColumns(args).withColumns(phis).withColumns(probs).drop(*phis, *args)


def ordered_probit_loglik(df: DataFrame, eta: str, items: dict[str, tuple[float, list[float]]], by: list[str] = ()) -> DataFrame:
    """Sum over rows and items of ln P; rows are individuals, NULL answers are skipped."""
    ll = add([F.coalesce(F.log(F.col(f"p_{i}")), F.lit(0.0)) for i in items])
    return ordered_probit_prob(df, eta, items).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ll).alias("ll"))


def ordered_probit_predict(df: DataFrame, eta: str, zeta: float, taus: list[float], name: str = "predicted") -> DataFrame:
    """Most probable category; ties go to the lowest."""
    k = len(taus) + 1
    trial = df.withColumns({f"__y{j}": F.lit(j) for j in range(1, k + 1)})
    trial = ordered_probit_prob(trial, eta, {f"__y{j}": (zeta, taus) for j in range(1, k + 1)})
    best = F.array_max(F.array(*[F.struct(F.col(f"p___y{j}").alias("p"), F.lit(-j).alias("j")) for j in range(1, k + 1)]))
    return trial.withColumn(name, (-best["j"]).cast("int")).select(*df.columns, name)


def ordered_probit_scores(df: DataFrame, eta: str, items: dict[str, tuple[float, list[float]]]) -> DataFrame:
    """Adds p_<item> and the derivatives of ln P: s_<item>_zeta, s_<item>_eta, s_<item>_tau_<j>; 0 for NULL answers."""
    dens, out = {}, {}
    for i, (z, taus) in items.items():
        y, k = F.col(i), len(taus) + 1
        for side, shift in (("u", 0), ("l", -1)):
            dens[f"__f{side}_{i}"] = norm_pdf(_cut(y, taus, shift) - F.lit(float(z)) * F.col(eta))
        fu, fl, p = F.col(f"__fu_{i}"), F.col(f"__fl_{i}"), F.col(f"p_{i}")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        out[f"s_{i}_zeta"] = zero(-(fu - fl) * F.col(eta) / p)
        out[f"s_{i}_eta"] = zero(-(fu - fl) * F.lit(float(z)) / p)
        for j in range(1, k):
            out[f"s_{i}_tau_{j}"] = zero(F.when(y == j, fu / p).when(y == j + 1, -fl / p).otherwise(0.0))
    return ordered_probit_prob(df, eta, items).withColumns(dens).withColumns(out).drop(*dens)


# ---- Gaussian measurement --------------------------------------------------------------------------------

def gaussian_logpdf(x: Column, mean: Column, var: float | Column) -> Column:
    v = var if isinstance(var, Column) else F.lit(float(var))
    return -0.5 * F.log(2 * math.pi * v) - (x - mean) * (x - mean) / (2 * v)


def gaussian_measure_loglik(df: DataFrame, eta: str, items: dict[str, tuple[float, float]], by: list[str] = ()) -> DataFrame:
    """items: item -> (zeta, sigma^2); NULL answers are skipped."""
    ll = add([F.coalesce(gaussian_logpdf(F.col(i), F.lit(float(z)) * F.col(eta), s2), F.lit(0.0)) for i, (z, s2) in items.items()])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ll).alias("ll"))


def measurement_gradient(df: DataFrame, eta: str, items: dict[str, tuple[float, float]]) -> DataFrame:
    """(item, d_zeta, d_sigma2) of the Gaussian log-likelihood, summed over the rows."""
    from .stats import inline
    exprs, rows = [], []
    for i, (z, s2) in items.items():
        r = F.col(i) - F.lit(float(z)) * F.col(eta)
        exprs += [F.sum(r * F.col(eta) / F.lit(float(s2))).alias(f"z_{i}"),
                  F.sum(-0.5 / F.lit(float(s2)) + r * r / (2 * F.lit(float(s2)) ** 2)).alias(f"s_{i}")]
        rows.append({"item": F.lit(i), "d_zeta": F.col(f"z_{i}"), "d_sigma2": F.col(f"s_{i}")})
    return inline(df.agg(*exprs), [], rows)


# ---- structural equations --------------------------------------------------------------------------------

def structural_predict(df: DataFrame, equations: list[tuple[str, dict[str, float], float, str | None]]) -> DataFrame:
    """Latent variables along the path order: eta = gamma * predictors + sqrt(sigma2) * draw.

    ``equations``: (eta, {predictor: gamma}, sigma2, draw column) with predictors defined before use.
    """
    out = df
    for eta, gamma, s2, draw in equations:
        value = add([F.lit(float(g)) * F.col(c) for c, g in gamma.items()]) if gamma else F.lit(0.0)
        if draw:
            value = value + F.lit(math.sqrt(s2)) * F.col(draw)
        out = out.withColumn(eta, value)
    return out


def structural_loglik(df: DataFrame, equations: list[tuple[str, dict[str, float], float]], by: list[str] = ()) -> DataFrame:
    """Gaussian density of each eta given its predictors."""
    ll = add([gaussian_logpdf(F.col(eta), add([F.lit(float(g)) * F.col(c) for c, g in gamma.items()]) if gamma else F.lit(0.0), s2)
              for eta, gamma, s2 in equations])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ll).alias("ll"))


def structural_gradient(df: DataFrame, equations: list[tuple[str, dict[str, float], float]], d_eta: dict[str, str]) -> DataFrame:
    """(eta, predictor, d_gamma): derivatives passed down the paths.

    ``d_eta`` names the column with the direct derivative of the log-likelihood by each eta (from measurement and
    choice). An eta that predicts later ones receives their total derivative times gamma (chain rule), so the
    equations are walked from last to first.
    """
    from .stats import inline
    total = {eta: F.coalesce(F.col(d_eta[eta]), F.lit(0.0)) if eta in d_eta else F.lit(0.0) for eta, _, _ in equations}
    for eta, gamma, _ in reversed(equations):
        for c, g in gamma.items():
            if c in total:
                total[c] = total[c] + F.lit(float(g)) * total[eta]
    exprs, rows = [], []
    for eta, gamma, _ in equations:
        for c in gamma:
            exprs.append(F.sum(total[eta] * F.col(c)).alias(f"{eta}__{c}"))
            rows.append({"eta": F.lit(eta), "predictor": F.lit(c), "d_gamma": F.col(f"{eta}__{c}")})
    return inline(df.agg(*exprs), [], rows)


def structural_ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Least squares without intercept: n, gamma_<x> for each predictor, sigma^2 (ddof = rank), R^2 against the variance of y.

    Dependent predictors share their effect (``leastsq.solve``); without a degree of freedom left sigma^2 is NULL. No complete row gives
    no result row."""
    groups = moments(df, {x: F.col(x) for x in xs}, F.col(y), extra=[F.var_pop("__y").alias("vy")])
    k = len(xs)

    def rows(group, m) -> list[tuple]:
        n = int(group["n"])
        b, _, s2, rss, _ = solve(m[:k, :k], m[:k, k], m[k, k], n)
        return [(n, *map(float, b), s2, 1 - rss / (n * group["vy"]) if group["vy"] else None)]
    names = ", ".join(f"gamma_{x} double" for x in xs)
    return solved(groups, [], k, rows, f"n bigint, {names}, sigma2 double, r2 double")


def likelihood_parts(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Per individual the log-likelihood of each part (tables with ``key`` and ``ll``), its share of the total,
    and whether any part is not finite."""
    out = None
    for name, df in parts.items():
        one = df.select(key, F.col("ll").alias(f"ll_{name}"))
        out = one if out is None else out.join(one, key, "full_outer")
    vals = [F.coalesce(F.col(f"ll_{n}"), F.lit(0.0)) for n in parts]
    bad = F.lit(False)
    for n in parts:
        c = F.col(f"ll_{n}")
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    out = out.withColumn("ll_total", add(vals)).withColumn("not_finite", bad)
    total = F.when(F.col("ll_total") != 0, F.col("ll_total"))
    return out.withColumns({f"share_{n}": F.col(f"ll_{n}") / total for n in parts})
