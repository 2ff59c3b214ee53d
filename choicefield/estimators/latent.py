"""Factor, path and structural models from covariance matrices.

Spark computes n, means and covariances (``cov_sufficient_stats``), per group where asked: per segment, per model
or per bootstrap replicate. Each p x p matrix (p items) is then fitted in its own ``applyInPandas`` group by
Fisher scoring of the Gaussian likelihood. The data rows never reach Python.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import two_sided_p
from ..functions.scalars import safe_div
from ..functions.tails import chi2_sf
from ..operators.stats import cov_sufficient_stats

PARAM_COLUMNS = "lval string, op string, rval string, estimate double, std_err double, z double, p_value double, std_estimate double"
FIT_NAMES = ["ll", "chi2", "df", "cfi", "tli", "rmsea", "srmr", "aic", "bic", "n", "converged"]


class _Model:
    """Sigma = L A P A' L' + T with A = (I - B)^-1; free entries of L, B, P and T are the parameters.

    ``factors``: factor -> items (first loading 1; a factor with one item is that item). ``paths``: (to, from).
    """

    def __init__(self, factors: dict[str, list[str]], paths: list[tuple[str, str]], items: list[str]):
        self.f, self.items = list(factors), items
        self.L0 = np.zeros((len(items), len(self.f)))
        self.free: list[tuple[str, int, int]] = []
        for j, f in enumerate(self.f):
            for k, i in enumerate(factors[f]):
                r = items.index(i)
                if k == 0:
                    self.L0[r, j] = 1.0
                else:
                    self.free.append(("L", r, j))
                if len(factors[f]) > 1:
                    self.free.append(("T", r, r))
        targets = {t for t, _ in paths}
        self.free += [("B", self.f.index(t), self.f.index(s)) for t, s in paths]
        self.free += [("P", j, j) for j in range(len(self.f))]
        outer = [j for j, f in enumerate(self.f) if f not in targets]
        self.free += [("P", a, b) for x, a in enumerate(outer) for b in outer[x + 1:]]

    def matrices(self, theta):
        m = {"L": self.L0.copy(), "B": np.zeros((len(self.f),) * 2), "P": np.zeros((len(self.f),) * 2), "T": np.zeros((len(self.items),) * 2)}
        for (kind, r, c), v in zip(self.free, theta):
            m[kind][r, c] = v
            if kind == "P":
                m[kind][c, r] = v
        return m, np.linalg.inv(np.eye(len(self.f)) - m["B"])

    def implied(self, theta):
        m, a = self.matrices(theta)
        la = m["L"] @ a
        return la @ m["P"] @ la.T + m["T"]

    def jacobian(self, theta):
        m, a = self.matrices(theta)
        la, ap = m["L"] @ a, a @ m["P"] @ a.T
        out = []
        for kind, r, c in self.free:
            d = np.zeros((len(self.items),) * 2)
            if kind == "T":
                d[r, r] = 1.0
            elif kind == "L":
                d[r] += (ap @ m["L"].T)[c]
                d = d + d.T
            elif kind == "B":
                x = np.outer(la[:, r], (ap @ m["L"].T)[c])
                d = x + x.T
            else:
                x = np.outer(la[:, r], la[:, c])
                d = x if r == c else x + x.T
            out.append(d)
        return out

    def start(self, s):
        by = {"L": lambda r, c: float(np.sign(s[r, int(np.argmax(self.L0[:, c]))]) or 1.0), "T": lambda r, c: 0.5 * s[r, r],
              "B": lambda r, c: 0.0,
              "P": lambda r, c: 0.0 if r != c else 0.5 * s[int(np.argmax(self.L0[:, r])), int(np.argmax(self.L0[:, r]))]}
        return np.array([by[k](r, c) for k, r, c in self.free])

    def name(self, kind, r, c):
        if kind == "L":
            return self.items[r], "~", self.f[c]
        if kind == "T":
            return self.items[r], "~~", self.items[r]
        return self.f[r], "~" if kind == "B" else "~~", self.f[c]


def _objective(s, sigma):
    sign, logdet = np.linalg.slogdet(sigma)
    return math.inf if sign <= 0 else logdet + float(np.trace(np.linalg.solve(sigma, s)))


def _fit(model: _Model, s: np.ndarray, n: int, max_iter: int = 200):
    theta = model.start(s)
    value = _objective(s, model.implied(theta))
    converged = False
    for _ in range(max_iter):
        w = np.linalg.inv(model.implied(theta))
        half = [w @ d for d in model.jacobian(theta)]
        core = w @ s - np.eye(len(s))
        g = np.array([0.5 * n * np.sum(core.T * h) for h in half])
        info = 0.5 * n * np.array([[np.sum(a * b.T) for b in half] for a in half])
        move = np.linalg.pinv(info) @ g
        if g @ move < 1e-9 * n:
            converged = True
            break
        step = 1.0
        while step > 1e-8:
            v = _objective(s, model.implied(theta + step * move))
            if v < value:
                break
            step /= 2
        else:
            break
        theta, value = theta + step * move, v
    return theta, np.linalg.pinv(info), value, converged


def _rows(model: _Model, s: np.ndarray, n: int):
    """Parameter rows and fit numbers of one covariance matrix."""
    theta, cov, value, converged = _fit(model, s, n)
    m, a = model.matrices(theta)
    latent = a @ m["P"] @ a.T
    sd_f, sd_i = np.sqrt(np.diag(latent)), np.sqrt(np.diag(model.implied(theta)))
    rows = []
    for j, (kind, r, c) in enumerate(model.free):
        se = math.sqrt(max(cov[j, j], 0.0))
        if kind == "L":
            scale = sd_f[c] / sd_i[r]
        elif kind == "T":
            scale = 1 / sd_i[r] ** 2
        else:
            scale = sd_f[c] / sd_f[r] if kind == "B" else 1 / (sd_f[r] * sd_f[c])
        z = theta[j] / se if se > 0 else None
        rows.append((*model.name(kind, r, c), theta[j], se, z, math.erfc(abs(z) / math.sqrt(2)) if z is not None else None, theta[j] * scale))
    for r, c in zip(*np.nonzero(model.L0)):
        rows.append((model.items[r], "~", model.f[c], 1.0, None, None, None, sd_f[c] / sd_i[r]))
    p, k = len(s), len(theta)
    sigma = model.implied(theta)
    f0 = float(np.log(np.diag(s)).sum() - np.linalg.slogdet(s)[1])
    chi2, df = (n - 1) * max(value - np.linalg.slogdet(s)[1] - p, 0.0), p * (p + 1) // 2 - k
    b_chi2, b_df = (n - 1) * f0, p * (p - 1) // 2
    d, bd = max(chi2 - df, 0.0), max(b_chi2 - b_df, chi2 - df, 0.0)
    corr = lambda x, y: x / np.sqrt(np.outer(np.diag(y), np.diag(y)))
    resid = (corr(s, s) - corr(sigma, s))[np.tril_indices(p)]
    ll = -0.5 * n * (p * math.log(2 * math.pi) + value)
    tli = (b_chi2 / b_df - chi2 / df) / (b_chi2 / b_df - 1) if df > 0 and b_df > 0 and b_chi2 != b_df else None
    fit = dict(ll=ll, chi2=chi2, df=float(df), cfi=1 - d / bd if bd > 0 else 1.0, tli=tli,
               rmsea=math.sqrt(d / (df * (n - 1))) if df > 0 else 0.0, srmr=math.sqrt(float(np.mean(resid ** 2))),
               aic=-2 * ll + 2 * k, bic=-2 * ll + k * math.log(n), n=float(n), converged=float(converged))
    return rows, fit


def _matrix(pdf: pd.DataFrame, items: list[str]) -> np.ndarray:
    s = np.zeros((len(items), len(items)))
    for a, b, v in zip(pdf["var1"], pdf["var2"], pdf["cov"]):
        if a in items and b in items:
            s[items.index(a), items.index(b)] = s[items.index(b), items.index(a)] = v
    return s


def fit_covariances(stats: DataFrame, keys: list[str], factors: dict[str, list[str]], paths: list[tuple[str, str]] = ()) -> DataFrame:
    """Fit the model to every group of covariance rows: (keys, section, parameter columns).

    Parameter rows have section 'Parameters'; fit numbers have section 'Model_Fit' with the name in ``lval`` and the
    value in ``estimate``. A group that cannot be fitted gives one row with NULL estimate (counted, never 0).
    """
    items = [i for cols in factors.values() for i in cols]
    paths = list(paths)
    kinds = ", ".join(f"{k} {stats.schema[k].dataType.simpleString()}" for k in keys)
    schema = ", ".join(x for x in (kinds, "section string", PARAM_COLUMNS) if x)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = [pdf[k].iloc[0] for k in keys]
        try:
            rows, fit = _rows(_Model(factors, paths, items), _matrix(pdf, items), int(pdf["n"].iloc[0]))
            out = [(*head, "Parameters", *r) for r in rows]
            out += [(*head, "Model_Fit", k, None, None, fit[k], None, None, None, None) for k in FIT_NAMES]
        except (np.linalg.LinAlgError, ValueError, FloatingPointError):
            out = [(*head, "Failed", None, None, None, None, None, None, None, None)]
        return pd.DataFrame(out, columns=[*keys, "section", "lval", "op", "rval", "estimate", "std_err", "z", "p_value", "std_estimate"])
    return stats.groupBy(*keys).applyInPandas(run, schema)


def one_factor_fit(df: DataFrame, factors: dict[str, list[str]]) -> DataFrame:
    """Each factor on its own: loadings, unique variances and fit."""
    out = None
    for f, items in factors.items():
        part = fit_covariances(cov_sufficient_stats(df, items), [], {f: items}).withColumn("model", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def multi_factor_fit(df: DataFrame, factors: dict[str, list[str]], keys: list[str] = ()) -> DataFrame:
    """Correlated factors."""
    return sem_fit(df, factors, [], keys)


def sem_fit(df: DataFrame, factors: dict[str, list[str]], paths: list[tuple[str, str]], keys: list[str] = (), weight: str | None = None) -> DataFrame:
    """Factors and paths; one fit per group of ``keys``."""
    items = [i for cols in factors.values() for i in cols]
    return fit_covariances(cov_sufficient_stats(df, items, keys, weight), list(keys), factors, paths)


def all_paths_regression(df: DataFrame, scores: list[str]) -> DataFrame:
    """Each score as target, all others as predictors: one small solve per target on one shared covariance matrix."""
    stats = cov_sufficient_stats(df, scores)
    schema = "target string, predictor string, estimate double, std_err double, r2 double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n, target = _matrix(pdf, scores), int(pdf["n"].iloc[0]), pdf["target"].iloc[0]
        y = scores.index(target)
        xs = [i for i in range(len(scores)) if i != y]
        inv = np.linalg.pinv(s[np.ix_(xs, xs)])
        b = inv @ s[xs, y]
        resid = s[y, y] - b @ s[xs, y]
        se = np.sqrt(np.maximum(np.diag(inv) * resid / (n - len(xs) - 1), 0))
        return pd.DataFrame({"target": target, "predictor": [scores[i] for i in xs], "estimate": b, "std_err": se, "r2": 1 - resid / s[y, y]})
    each = stats.withColumn("target", F.explode(F.array(*[F.lit(c) for c in scores])))
    fits = each.groupBy("target").applyInPandas(run, schema)
    return fits.withColumn("z", safe_div(F.col("estimate"), F.col("std_err"))).withColumn("p_value", two_sided_p(F.col("z")))


def fit_indices(fits: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per model: LL, chi-square with p, CFI, TLI, RMSEA, SRMR, AIC, BIC."""
    rows = fits.filter("section = 'Model_Fit'")
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("lval") == n, F.col("estimate"))).alias(n) for n in FIT_NAMES])
    return wide.withColumn("p_value", chi2_sf("chi2", "df"))


def sem_params(fits: DataFrame, items: list[str]) -> DataFrame:
    """Parameter rows with their part: loading, path, error variance, factor variance or covariance."""
    item = F.col("lval").isin(items)
    kind = (F.when((F.col("op") == "~") & item, "loading").when(F.col("op") == "~", "path").when(item, "error")
            .when(F.col("lval") == F.col("rval"), "variance").otherwise("covariance"))
    return fits.filter("section = 'Parameters'").withColumn("part", kind)


def standardize_params(params: DataFrame, sds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """est * sd(x) / sd(y) for regressions, est / (sd sd) for covariances; ``sds``: (keys, variable, sd)."""
    keys = list(keys)
    left = sds.select(*keys, F.col("variable").alias("lval"), F.col("sd").alias("sd_l"))
    right = sds.select(*keys, F.col("variable").alias("rval"), F.col("sd").alias("sd_r"))
    j = params.join(left, [*keys, "lval"]).join(right, [*keys, "rval"])
    e = F.col("estimate")
    return j.withColumn("standardized", F.when(F.col("op") == "~", safe_div(e * F.col("sd_r"), F.col("sd_l")))
                        .otherwise(safe_div(e, F.col("sd_l") * F.col("sd_r")))).drop("sd_l", "sd_r")


def factor_corr_model(params: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Latent correlations (symmetric) with p from the '~~' rows between factors."""
    keys = list(keys)
    cov = params.filter((F.col("op") == "~~") & (F.col("lval") != F.col("rval")))
    var = params.filter((F.col("op") == "~~") & (F.col("lval") == F.col("rval")))
    v1 = var.select(*keys, F.col("lval"), F.col("estimate").alias("v1"))
    v2 = var.select(*keys, F.col("rval"), F.col("estimate").alias("v2"))
    up = cov.join(v1, [*keys, "lval"]).join(v2, [*keys, "rval"]).select(
        *keys, F.col("lval").alias("var1"), F.col("rval").alias("var2"), (F.col("estimate") / F.sqrt(F.col("v1") * F.col("v2"))).alias("r"), "p_value")
    return up.unionByName(up.select(*keys, F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r", "p_value"))


def residual_cov(observed: DataFrame, implied: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Observed minus implied covariance; ``implied`` may lack the keys when one matrix serves all groups."""
    on = [*[k for k in keys if k in implied.columns], "var1", "var2"]
    return (observed.select(*keys, "var1", "var2", F.col("cov").alias("observed"))
            .join(implied.select(*on, F.col("cov").alias("implied")), on)
            .select(*keys, "var1", "var2", "observed", "implied")
            .withColumn("residual", F.col("observed") - F.col("implied")))


def modification_index(residuals: DataFrame, variances: DataFrame, candidates: DataFrame, n: int | str, keys: list[str] = (),
                       threshold: float = 3.84) -> DataFrame:
    """For each candidate path from_var -> to_var: MI = n r^2 / var(to), expected change r / var(from), p (1 df)."""
    keys = list(keys)
    sym = residuals.select(*keys, "var1", "var2", "residual").unionByName(
        residuals.filter("var1 <> var2").select(*keys, F.col("var2").alias("var1"), F.col("var1").alias("var2"), "residual"))
    c = candidates.join(sym.withColumnsRenamed({"var1": "from_var", "var2": "to_var"}), [*keys, "from_var", "to_var"])
    v = variances.select(*keys, F.col("variable").alias("to_var"), F.col("variance").alias("var_to"))
    w = variances.select(*keys, F.col("variable").alias("from_var"), F.col("variance").alias("var_from"))
    j = c.join(v, [*keys, "to_var"]).join(w, [*keys, "from_var"])
    size = F.col(n) if isinstance(n, str) else F.lit(n)
    r = F.col("residual")
    j = j.withColumns({"mi": safe_div(size * r * r, F.col("var_to")), "expected_change": safe_div(r, F.col("var_from"))})
    return (j.withColumn("__root", F.sqrt("mi")).withColumn("p_value", two_sided_p(F.col("__root")))
            .withColumn("recommended", F.col("mi") >= threshold).drop("__root", "var_to", "var_from"))


# ---- path structures as edge tables ----------------------------------------------------------------------

def path_models(roles: DataFrame) -> DataFrame:
    """(model, kind, to_var, from_var) for the standard structures of rows (model, x, m1, m2, y)."""
    edges = {
        "simple": [("m1", "x"), ("y", "m1"), ("y", "x")],
        "multiple": [("m1", "x"), ("m2", "x"), ("y", "m1"), ("y", "m2"), ("y", "x")],
        "serial": [("m1", "x"), ("m2", "x"), ("m2", "m1"), ("y", "m1"), ("y", "m2"), ("y", "x")],
        "saturated": [(a, b) for a in ("x", "m1", "m2", "y") for b in ("x", "m1", "m2", "y") if a != b],
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(t).alias("to_var"), F.col(s).alias("from_var")) for k, e in edges.items() for t, s in e])
    return roles.select("model", F.explode(rows).alias("e")).select("model", "e.*")
