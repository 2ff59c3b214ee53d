"""The driver side of an estimation: a k-vector, a k x k matrix and one Spark aggregate per step."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.models import coef_table

RIDGE = 1e-8


@dataclass
class Point:
    """Log-likelihood, gradient and information (negative Hessian or outer products) at one parameter vector."""
    ll: float
    gradient: np.ndarray
    information: np.ndarray

    @property
    def finite(self) -> bool:
        return math.isfinite(self.ll) and bool(np.isfinite(self.gradient).all()) and bool(np.isfinite(self.information).all())


def symmetric(names: list[str], row: Row, prefix: str) -> np.ndarray:
    """Upper triangle ``<prefix><a>_<b>`` of a one-row aggregate as a full matrix."""
    m = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            v = row[f"{prefix}{a}_{names[j]}"]
            m[i, j] = m[j, i] = float("nan") if v is None else v
    return m


def inverse(m: np.ndarray) -> np.ndarray:
    """(M + 1e-8 I)^-1, pseudo-inverse when singular."""
    try:
        return np.linalg.inv(m + RIDGE * np.eye(len(m)))
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m)


@dataclass
class Fit:
    names: list[str]
    theta: np.ndarray
    point: Point
    converged: bool
    trace: list[tuple] = field(default_factory=list)
    n_obs: int = 0
    null_ll: float | None = None
    robust: np.ndarray | None = None

    @property
    def params(self) -> dict[str, float]:
        return dict(zip(self.names, self.theta.tolist()))

    def covariance(self) -> np.ndarray:
        return self.robust if self.robust is not None else inverse(self.point.information)

    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.abs(np.diag(self.covariance())))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(b), float(s)) for n, b, s in zip(self.names, self.theta, self.std_errors())]
        return coef_table(spark.createDataFrame(rows, "parameter string, estimate double, std_error double"), "estimate", "std_error")

    def report(self, spark: SparkSession) -> DataFrame:
        """The coefficients, and whether and how the search ended: converged, n_iterations, max_gradient on every row."""
        return self.coefficients(spark).withColumns({
            "converged": F.lit(self.converged), "n_iterations": F.lit(len(self.trace)), "max_gradient": F.lit(float(np.abs(self.point.gradient).max()))})

    def statistics(self, spark: SparkSession) -> DataFrame:
        k, ll, n = len(self.names), self.point.ll, self.n_obs
        rho = 1 - ll / self.null_ll if self.null_ll else None
        adj = 1 - (ll - k) / self.null_ll if self.null_ll else None
        row = (ll, k, n, -2 * ll + 2 * k, -2 * ll + k * math.log(n) if n else None, rho, adj, len(self.trace),
               self.converged, float(np.abs(self.point.gradient).max()))
        return spark.createDataFrame([row], "ll double, n_params int, n_obs bigint, aic double, bic double, rho2 double, "
                                            "adj_rho2 double, n_iterations int, converged boolean, max_gradient double")

    def iterations(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.trace, "iteration int, ll double, max_gradient double, step double")

    def result_rows(self, spark: SparkSession, run: str) -> DataFrame:
        """(run, section, parameter, estimate, std_error, p_value): what ``model_table`` reads."""
        coefs = self.coefficients(spark).select(F.lit(run).alias("run"), F.lit("Parameters").alias("section"), "parameter",
                                                "estimate", "std_error", "p_value")
        stats = self.statistics(spark).select(F.col("ll").alias("LL"), F.col("aic").alias("AIC"), F.col("bic").alias("BIC"))
        fit = stats.unpivot([], ["LL", "AIC", "BIC"], "parameter", "estimate")
        none = F.lit(None).cast("double")
        return coefs.unionByName(fit.select(F.lit(run).alias("run"), F.lit("Model_Fit").alias("section"), "parameter", "estimate",
                                            none.alias("std_error"), none.alias("p_value")))


def numeric_information(points: Callable[[list[np.ndarray]], list[Point]], theta: np.ndarray, width: float = 1e-4) -> np.ndarray:
    """Negative Hessian from the gradients at 2k perturbed points, which ``points`` evaluates in one pass over the data."""
    k = len(theta)
    h = width * (1 + np.abs(theta))
    moved = points([theta + sign * h[i] * np.eye(k)[i] for i in range(k) for sign in (1, -1)])
    rows = np.array([(moved[2 * i + 1].gradient - moved[2 * i].gradient) / (2 * h[i]) for i in range(k)])
    return (rows + rows.T) / 2


def _bfgs(inv: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    sy = float(s @ y)
    if sy < 1e-12:
        return inv
    left = np.eye(len(s)) - np.outer(s, y) / sy
    return left @ inv @ left.T + np.outer(s, s) / sy


def maximise(names: list[str], start: np.ndarray, evaluate: Callable[[dict[str, float]], Point], n_obs: int,
             max_iter: int = 50, tol: float = 1e-7, allowed: Callable[[dict[str, float]], bool] | None = None,
             learn_curvature: bool = False) -> Fit:
    """Newton (or BHHH, when the information is the outer product) with step halving; converged when the decrement
    g' I^-1 g is below ``tol``.

    ``learn_curvature``: after a short step, update the inverse from the gradients seen (BFGS) instead of taking the
    new information matrix; for simulated likelihoods, whose outer products can be a poor Hessian off the optimum.
    """
    theta = np.asarray(start, dtype=float)
    point = evaluate(dict(zip(names, theta)))
    trace = [(0, point.ll, float(np.abs(point.gradient).max()), 0.0)]
    converged = False
    inv = inverse(point.information)
    for it in range(1, max_iter + 1):
        direction = inv @ point.gradient
        if point.gradient @ direction < tol:
            converged = True
            break
        step, found = 1.0, None
        while step > 1e-6:
            trial = theta + step * direction
            if allowed is None or allowed(dict(zip(names, trial))):
                candidate = evaluate(dict(zip(names, trial)))
                if candidate.finite and candidate.ll >= point.ll:
                    found = candidate
                    break
            step /= 2
        if found is None:
            # no step raises the likelihood: at the optimum up to the sums' own rounding, or stuck
            converged = bool(point.gradient @ direction < max(tol, 1e-12 * abs(point.ll)))
            break
        if learn_curvature and step < 0.25:
            inv = _bfgs(inv, trial - theta, point.gradient - found.gradient)
        else:
            inv = inverse(found.information)
        theta, point = trial, found
        trace.append((it, point.ll, float(np.abs(point.gradient).max()), step))
    return Fit(names, theta, point, converged, trace, n_obs)


def maximise_together(models: dict[str, list[str]], evaluate: Callable[[dict[str, np.ndarray]], dict[str, Point]], max_iter: int = 50, tol: float = 1e-7) -> dict[str, Fit]:
    """Newton searches of several models (name -> parameters) from 0, side by side: ``evaluate`` gets the trial vectors of all that
    are not done and is called once a step. A model whose trial is worse tries half the step in the next call."""
    theta = {name: np.zeros(len(use)) for name, use in models.items()}
    point = evaluate(theta)
    trace = {name: [(0, p.ll, float(np.abs(p.gradient).max(initial=0)), 0.0)] for name, p in point.items()}
    step, converged, left = dict.fromkeys(models, 1.0), dict.fromkeys(models, False), list(models)
    for it in range(1, max_iter + 1):
        direction = {n: inverse(point[n].information) @ point[n].gradient for n in left}
        for n in list(left):
            gain = point[n].gradient @ direction[n]
            # below the smallest step no step raises the likelihood: at the optimum up to rounding, or stuck
            if gain < tol or step[n] < 1e-6:
                converged[n] = bool(gain < max(tol, 1e-12 * abs(point[n].ll)))
                left.remove(n)
        if not left:
            break
        trial = {n: theta[n] + step[n] * direction[n] for n in left}
        for n, p in evaluate(trial).items():
            if p.finite and p.ll >= point[n].ll:
                theta[n], point[n] = trial[n], p
                trace[n].append((it, p.ll, float(np.abs(p.gradient).max()), step[n]))
                step[n] = 1.0
            else:
                step[n] /= 2
    return {n: Fit(list(models[n]), theta[n], point[n], converged[n], trace[n]) for n in models}
