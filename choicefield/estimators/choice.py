"""Choice-model estimators: conditional logit, binary probit, ordered probit, penalised logit."""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from ..functions.scalars import PROB_FLOOR
from ..operators import blocks, kernels, measurement
from ..operators.encode import zscore_apply, scale_stats
from . import grid
from .newton import Fit, Point, inverse, maximise, numeric_information, symmetric


def _cached(df: DataFrame) -> DataFrame:
    """The design of an estimation: read once per step, spilled to disk, rebuilt by Spark when an executor is lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def prepare_mnl(df: DataFrame, set_keys: list[str], attrs: list[str], chosen: str, key: str | None = None) -> DataFrame:
    """Difference design, kept. Building it placed the rows by choice set (one shuffle), and the cache remembers that:
    a step aggregates by set without shuffling rows. Sets above the hot limit were salted; for those a step
    shuffles partial sums."""
    return _cached(kernels.relative_design(df, set_keys, attrs, chosen, [key] if key else []))


def _pairs(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def fit_mnl(df: DataFrame | None, set_keys: list[str], attrs: list[str], chosen: str = "chosen", key: str | None = None,
            robust: bool = False, rel: DataFrame | None = None, start: dict[str, float] | None = None) -> Fit:
    """Conditional logit by Newton steps; one aggregate per step gives LL, gradient and exact Hessian.

    ``rel`` reuses a prepared design (a superset of ``attrs`` is fine). ``robust``: sandwich over individuals. Beyond
    ``kernels.FEW`` attributes the sums are blocks of k x k (``grid``), with the same values.
    """
    own = rel is None
    rel = prepare_mnl(df, set_keys, attrs, chosen, key) if own else rel
    design = grid.Design(rel, set_keys, list(attrs)) if len(attrs) > kernels.FEW else None
    n_sets = 0

    def evaluate(theta):
        nonlocal n_sets
        if design is not None:
            n_sets, points = design.points(np.array([[theta[a] for a in attrs]], dtype=float))
            return points[0]
        sets = kernels.set_scores(rel, set_keys, theta, hessian=True)
        row = sets.agg(F.count("*").alias("n"), F.sum("ll").alias("ll"), *[F.sum(f"g_{a}").alias(f"g_{a}") for a in attrs],
                       *[F.sum(-F.col(f"h_{a}_{b}")).alias(f"i_{a}_{b}") for a, b in _pairs(attrs)]).first()
        n_sets = row["n"]
        return Point(row["ll"], np.array([row[f"g_{a}"] for a in attrs]), symmetric(attrs, row, "i_"))
    begin = np.array([(start or {}).get(a, 0.0) for a in attrs])
    fit = maximise(attrs, begin, evaluate, 0)
    fit.n_obs = n_sets
    # the first point is the null model unless a start was given
    fit.null_ll = evaluate({a: 0.0 for a in attrs}).ll if start else fit.trace[0][1]
    if robust:
        if key is None:
            raise ValueError("robust standard errors need the individual key")
        fit.robust = sandwich(fit, kernels.individual_scores(rel, key, set_keys, fit.params))
    if design is not None:
        design.drop()
    if own:
        rel.unpersist()
    return fit


def opg_of(scores: DataFrame, names: list[str]) -> np.ndarray:
    return blocks.gram(scores, [f"g_{a}" for a in names])


def sandwich(fit: Fit, scores: DataFrame) -> np.ndarray:
    """H^-1 B H^-1 with B the outer products of individual scores."""
    h = inverse(fit.point.information)
    return h @ opg_of(scores, fit.names) @ h


def matrix_table(spark, names: list[str], m: np.ndarray) -> DataFrame:
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "row string, col string, value double")


def opg_covariance(scores: DataFrame, names: list[str]) -> DataFrame:
    """(OPG + 1e-8 I)^-1 as (row, col, value)."""
    return matrix_table(scores.sparkSession, names, inverse(opg_of(scores, names)))


# ---- binary models ---------------------------------------------------------------------------------------

def _logit_link(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row ln P(y), its derivative by v, and the information by v (here minus the second derivative)."""
    p = np.clip(1 / (1 + np.exp(-np.clip(v, -700, 700))), 1e-15, 1 - 1e-15)
    return np.where(y == 1, np.log(p), np.log(1 - p)), y - p, p * (1 - p)


def _probit_link(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_logit_link``; the information is the expected one."""
    p = np.clip(vector.norm_cdf(v), PROB_FLOOR, 1 - PROB_FLOOR)
    f = vector.norm_pdf(v)
    return np.where(y == 1, np.log(p), np.log(1 - p)), (y - p) * f / (p * (1 - p)), f * f / (p * (1 - p))


def _binary_points(data: DataFrame, names: list[str], link, thetas: list[np.ndarray]) -> list[tuple[Point, np.ndarray]]:
    """Point and outer products of the row scores at each parameter vector, from one pass; blocks of k x k, whatever k."""
    k = len(names)
    size = 1 + k + 2 * k * k

    def sums(batches):
        for batch in batches:
            x, y = blocks.columns_of(batch, names), blocks.columns_of(batch, ["__y"])[:, 0]
            out = []
            for theta in thetas:
                ll, score, weight = link(x @ theta, y)
                out += [[ll.sum()], x.T @ score, (x.T @ (weight[:, None] * x)).ravel(), (x.T @ ((score * score)[:, None] * x)).ravel()]
            yield np.concatenate(out)
    total = blocks.vector_sum(data.select("__y", *names), size * len(thetas), sums).reshape(len(thetas), size)
    return [(Point(float(t[0]), t[1:1 + k], t[1 + k:1 + k + k * k].reshape(k, k)), t[1 + k + k * k:].reshape(k, k)) for t in total]


def _fit_binary(data: DataFrame, names: list[str], link, penalty: np.ndarray, robust: bool, exact: bool) -> Fit:
    """``exact``: the link's information is minus the Hessian; otherwise the sandwich takes it from perturbed points."""
    def points(thetas: list[np.ndarray]) -> list[Point]:
        return [Point(p.ll - 0.5 * float(penalty @ (t * t)), p.gradient - penalty * t, p.information + np.diag(penalty))
                for t, (p, _) in zip(thetas, _binary_points(data, names, link, thetas))]
    counts = data.agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("m")).first()
    fit = maximise(names, np.zeros(len(names)), lambda theta: points([np.array(list(theta.values()))])[0], counts.n)
    m = min(max(counts.m, 1e-12), 1 - 1e-12)
    fit.null_ll = counts.n * (m * math.log(m) + (1 - m) * math.log(1 - m))
    if robust:
        h = inverse(fit.point.information if exact else numeric_information(points, fit.theta))
        fit.robust = h @ _binary_points(data, names, link, [fit.theta])[0][1] @ h
    return fit


def _with_const(df: DataFrame, attrs: list[str], chosen: str, intercept: bool = True) -> tuple[DataFrame, list[str]]:
    data = df.select(F.col(chosen).cast("double").alias("__y"), *[F.col(a).cast("double").alias(a) for a in attrs]).dropna()
    return (data.withColumn("const", F.lit(1.0)), ["const", *attrs]) if intercept else (data, list(attrs))


def fit_binary_probit(df: DataFrame, attrs: list[str], chosen: str = "chosen", intercept: bool = True, robust: bool = False) -> Fit:
    """P(y = 1) = Phi(V) by Fisher scoring. ``robust``: sandwich over the rows."""
    data, names = _with_const(df, attrs, chosen, intercept)
    data = _cached(data)
    fit = _fit_binary(data, names, _probit_link, np.zeros(len(names)), robust, exact=False)
    data.unpersist()
    return fit


# ---- ordered probit --------------------------------------------------------------------------------------

def _ordered_sums(items: list[str], theta: dict[str, np.ndarray], k: int):
    """Per item ln P, scores and their outer products; (eta, answers) rows, answers from 1."""
    def sums(batches):
        for batch in batches:
            eta, answers = blocks.columns_of(batch, ["__eta"])[:, 0], blocks.columns_of(batch, items, float("nan"))
            out = []
            for j, i in enumerate(items):
                seen = ~np.isnan(answers[:, j])
                y, e = np.clip(answers[seen, j].astype(int), 1, k), eta[seen]
                taus = np.concatenate(([-measurement.FAR], theta[i][1:], [measurement.FAR]))
                low, high = taus[y - 1] - theta[i][0] * e, taus[y] - theta[i][0] * e
                p = np.clip(vector.interval_prob(low, high), PROB_FLOOR, 1 - PROB_FLOOR)
                f_low, f_high = vector.norm_pdf(low) / p, vector.norm_pdf(high) / p
                s = np.zeros((len(e), k))
                s[:, 0] = (f_low - f_high) * e
                for t in range(1, k):
                    s[:, t] = np.where(y == t, f_high, 0.0) - np.where(y == t + 1, f_low, 0.0)
                out += [[np.log(p).sum()], s.sum(axis=0), (s.T @ s).ravel()]
            yield np.concatenate(out)
    return sums


def fit_ordered_probit(df: DataFrame, eta: str, items: list[str], categories: int = 5) -> dict[str, Fit]:
    """zeta and thresholds of every item given the latent score, by BHHH. One pass per step serves all items."""
    taus = [f"tau_{j}" for j in range(1, categories)]
    names = ["zeta", *taus]
    data = _cached(df.select(F.col(eta).cast("double").alias("__eta"), *items).filter("__eta is not null"))
    counts = data.agg(*[e for i in items for e in (F.count(i).alias(f"n_{i}"), *[
        F.avg(F.when(F.col(i).isNotNull(), (F.col(i) <= j).cast("double"))).alias(f"c{j}_{i}") for j in range(1, categories)])]).first()
    from statistics import NormalDist
    start = {}
    for i in items:
        shares = [min(max(counts[f"c{j}_{i}"], 1e-4 * j), 1 - 1e-4 * (categories - j)) for j in range(1, categories)]
        start[i] = np.array([0.1, *[NormalDist().inv_cdf(s) for s in shares]])
    k = len(names)
    size = 1 + k + k * k

    def evaluate_all(theta: dict[str, np.ndarray]) -> dict[str, Point]:
        total = blocks.vector_sum(data, size * len(items), _ordered_sums(items, theta, k)).reshape(len(items), size)
        return {i: Point(float(t[0]), t[1:1 + k], t[1 + k:].reshape(k, k)) for i, t in zip(items, total)}

    def ordered(t):
        return all(a < b for a, b in zip(t[1:], t[2:]))
    theta, points = start, evaluate_all(start)
    traces = {i: [(0, points[i].ll, float(np.abs(points[i].gradient).max()), 0.0)] for i in items}
    step, done = dict.fromkeys(items, 1.0), dict.fromkeys(items, False)
    for it in range(1, 101):
        direction = {i: inverse(points[i].information) @ points[i].gradient for i in items}
        done = {i: done[i] or bool(points[i].gradient @ direction[i] < 1e-7) for i in items}
        if all(done.values()):
            break
        trial = {i: theta[i] if done[i] else theta[i] + step[i] * direction[i] for i in items}
        for i in items:
            while not ordered(trial[i]):
                step[i] /= 2
                trial[i] = theta[i] + step[i] * direction[i]
        tried = evaluate_all(trial)
        for i in items:
            if done[i]:
                continue
            if tried[i].finite and tried[i].ll >= points[i].ll:
                theta, points = {**theta, i: trial[i]}, {**points, i: tried[i]}
                traces[i].append((it, tried[i].ll, float(np.abs(tried[i].gradient).max()), step[i]))
                step[i] = min(1.0, step[i] * 2)
            else:
                step[i] /= 2
                done[i] = step[i] < 1e-6
    data.unpersist()
    return {i: Fit(names, theta[i], points[i], done[i], traces[i], counts[f"n_{i}"]) for i in items}


# ---- logit of single components --------------------------------------------------------------------------

def fit_logit(df: DataFrame, attrs: list[str], chosen: str, l2: float = 0.0, standardise: bool = False, robust: bool = False) -> Fit:
    """Binary logit with intercept and optional ridge penalty l2/2 * |b|^2 (intercept free).

    ``standardise`` fits on z-scored columns and transforms the coefficients back. ``robust``: sandwich over the rows.
    """
    data, names = _with_const(df, attrs, chosen)
    stats = scale_stats(data, attrs, 0).first() if standardise else None
    if standardise:
        data = zscore_apply(data, attrs, scale_stats(data, attrs, 0), "")
    data = _cached(data)
    fit = _fit_binary(data, names, _logit_link, np.array([0.0] + [l2] * len(attrs)), robust, exact=True)
    data.unpersist()
    if standardise:
        mu = np.array([stats[f"mu_{a}"] for a in attrs])
        sd = np.array([s if (s := stats[f"sd_{a}"]) > 1e-10 else 1.0 for a in attrs])
        back = np.eye(len(names))
        back[0, 1:], back[1:, 1:] = -mu / sd, np.diag(1 / sd)
        fit.robust = back @ fit.covariance() @ back.T
        fit.theta = back @ fit.theta
    return fit


MODELS = {}


def register_model(name: str, fitter, *aliases: str) -> None:
    """Choice models by name; a caller may add their own."""
    for n in (name, *aliases):
        MODELS[n] = fitter


def create_model(name: str):
    if name not in MODELS:
        raise ValueError(f"unknown choice model {name}; known: {sorted(MODELS)}")
    return MODELS[name]


register_model("multinomial_logit", fit_mnl, "mnl", "conditional_logit")
register_model("binary_probit", fit_binary_probit, "probit")
register_model("binary_logit", fit_logit, "logit")
