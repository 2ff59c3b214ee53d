"""Utilities, choice probabilities and log-likelihoods on rows and choice sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import has_hot_group, with_group_values
from ..functions.normal import norm_cdf, with_normals
from ..functions.scalars import PROB_FLOOR, add, clip_prob, hash_unit

def linear(coefs: dict[str, float], intercept: float = 0.0) -> Column:
    """intercept + sum of coefficient * column."""
    return add([F.lit(float(intercept)), *[F.lit(float(b)) * F.col(c) for c, b in coefs.items()]])


# ---- components ------------------------------------------------------------------------------------------

def component_utility(coefs: dict[str, float], products: dict[tuple[str, ...], float] | None = None) -> Column:
    """One component: coefficients on columns and on products of columns."""
    out = linear(coefs)
    for cols, b in (products or {}).items():
        term = F.lit(float(b))
        for c in cols:
            term = term * F.col(c)
        out = out + term
    return out


def product(term: str) -> Column:
    """A column, or the product of the columns of "a*b"."""
    out = F.lit(1.0)
    for c in term.split("*"):
        out = out * F.col(c.strip())
    return out


def loading_score(loadings: dict[str, float]) -> Column:
    """sum(loading * item) / sum(loading^2) over the answered items; NULL without an answer."""
    seen = {i: F.col(i).isNotNull() for i in loadings}
    num = add([F.when(seen[i], F.lit(float(v)) * F.col(i)).otherwise(0.0) for i, v in loadings.items()])
    den = add([F.when(seen[i], F.lit(float(v) * float(v))).otherwise(0.0) for i, v in loadings.items()])
    return num / F.when(den > 0, den)


def factor_utility(score: str, direct: float, interactions: dict[str, float], weight: float = 1.0) -> Column:
    """weight * (direct * score + sum of b * score * attribute); a missing score gives 0."""
    body = F.lit(float(direct)) * F.col(score)
    for attr, b in interactions.items():
        body = body + F.lit(float(b)) * F.col(score) * F.col(attr)
    return F.lit(float(weight)) * F.coalesce(body, F.lit(0.0))


def total_utility(components: list[str], weights: dict[str, float] | None = None, how: str = "additive") -> Column:
    """Weighted sum, or product of (1 + weighted component) minus 1; a missing component counts as 0."""
    w = weights or {}
    parts = [F.lit(float(w.get(c, 1.0))) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in components]
    if how == "additive":
        return add(parts)
    if how != "multiplicative":
        raise ValueError(f"unknown aggregation {how}")
    out = F.lit(1.0)
    for p in parts:
        out = out * (1.0 + p)
    return out - 1.0


def utility_decomposition(df: DataFrame, components: dict[str, Column], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds the weighted contributions and ``total_utility``."""
    w = weights or {}
    parts = {n: F.lit(float(w.get(n, 1.0))) * F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in components.items()}
    out = df.withColumns(parts)
    return out.withColumn("total_utility", add([F.col(n) for n in parts]))


# ---- errors ----------------------------------------------------------------------------------------------

def error_draw(df: DataFrame, kind: str, scale: float, keys: list[str], seed: int, name: str = "error") -> DataFrame:
    """i.i.d. error by inverse distribution function of a keyed uniform: the same for any partitioning."""
    u, s = hash_unit(*[F.col(k) for k in keys], F.lit(seed)), F.lit(float(scale))
    if kind == "normal":
        return with_normals(df, {name: u}).withColumn(name, s * F.col(name))
    if kind not in ("gumbel", "logistic"):
        raise ValueError(f"unknown error law {kind}")
    c = F.col("__u")
    e = -F.log(-F.log(c)) if kind == "gumbel" else F.log(c / (1 - c))
    return df.withColumn("__u", u).withColumn(name, s * e).drop("__u")


def error_draw_correlated(df: DataFrame, scale: float, rho: float, set_keys: list[str], alt: str, seed: int,
                          name: str = "error") -> DataFrame:
    """Normal errors with equal correlation rho between the alternatives of a set."""
    keys = [F.col(k) for k in set_keys]
    out = with_normals(df, {"__z0": hash_unit(*keys, F.lit(f"common{seed}")), "__z1": hash_unit(*keys, F.col(alt), F.lit(f"own{seed}"))})
    e = F.lit(math.sqrt(rho)) * F.col("__z0") + F.lit(math.sqrt(1 - rho)) * F.col("__z1")
    return out.withColumn(name, F.lit(float(scale)) * e).drop("__z0", "__z1")


def logistic_prob(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


# ---- systematic utilities; an alternative with missing attributes (opt-out) has V = 0 ---------------------

def _or_zero(v: Column, beta: dict[str, float]) -> Column:
    present = F.lit(True)
    for c in beta:
        present = present & F.col(c).isNotNull()
    return F.when(present, v).otherwise(0.0)


def utility_asc(level: str, asc: dict, beta: dict[str, float], theta: dict | None = None, gamma: dict | None = None) -> Column:
    """V = ASC_level + beta x + theta_level LV + gamma_level LV x, by label level or alternative position.

    ``theta``: level -> {lv: value}; ``gamma``: level -> {(lv, attr): value}. A level without ASC has V = 0.
    """
    out = None
    for lev, a in asc.items():
        v = linear(beta, a)
        for lv, b in (theta or {}).get(lev, {}).items():
            v = v + F.lit(float(b)) * F.col(lv)
        for (lv, attr), b in (gamma or {}).get(lev, {}).items():
            v = v + F.lit(float(b)) * F.col(lv) * F.col(attr)
        hit = F.col(level) == F.lit(lev)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return _or_zero(out.otherwise(0.0), beta)


def utility_all_lv(intercept: float, beta: dict[str, float], lam: dict[str, float],
                   gamma: dict[tuple[str, str], float] | None = None) -> Column:
    v = linear({**beta, **lam}, intercept)
    for (lv, attr), b in (gamma or {}).items():
        v = v + F.lit(float(b)) * F.col(lv) * F.col(attr)
    return _or_zero(v, beta)


def utility_moderated(intercept: float, beta: dict[str, float], main: str, lam: float, moderators: dict[str, float]) -> Column:
    v = linear({**beta, main: lam}, intercept)
    for m, b in moderators.items():
        v = v + F.lit(float(b)) * F.col(main) * F.col(m)
    return _or_zero(v, beta)


def utility_basic(intercept: float, beta: dict[str, float], lv: str | None = None, lam: float = 1.0) -> Column:
    return _or_zero(linear({**beta, **({lv: lam} if lv else {})}, intercept), beta)


# ---- probabilities ---------------------------------------------------------------------------------------

def softmax_prob(df: DataFrame, keys: list[str], v: str, name: str = "prob", split: bool | None = None) -> DataFrame:
    """Max-shifted softmax inside each choice set; sets may have any size. ``split``: see ``with_group_values``."""
    split = has_hot_group(df, keys) if split is None else split
    top = with_group_values(df, keys, {"__m": F.max(v)}, split=split)
    top = top.withColumn("__e", F.exp(F.col(v) - F.col("__m")))
    out = with_group_values(top, keys, {"__s": F.sum("__e")}, split=split)
    return out.withColumn(name, F.col("__e") / F.col("__s")).drop("__m", "__e", "__s")


def mnl_loglik(df: DataFrame, keys: list[str], v: str, chosen: str, by: list[str] = (), floor: float = PROB_FLOOR,
               split: bool | None = None) -> DataFrame:
    """Sum of ln P(chosen) with P clipped to [floor, 1 - floor]; optionally per ``by``."""
    p = softmax_prob(df, keys, v, "__p", split).filter(F.col(chosen) == 1)
    return p.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sets"), F.sum(F.log(clip_prob(F.col("__p"), floor))).alias("ll"))


def probit_prob(v: Column, floor: float = PROB_FLOOR) -> Column:
    return clip_prob(norm_cdf(v), floor)


def probit_loglik(df: DataFrame, v: str, chosen: str, by: list[str] = (), floor: float = PROB_FLOOR) -> DataFrame:
    p = probit_prob(F.col(v), floor)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(chosen) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("ll"))


def predict_binary(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def predict_choice(df: DataFrame, keys: list[str], alt: str, prob: str) -> DataFrame:
    """Most probable alternative per set; ties go to the smallest alternative."""
    best = F.max_by(F.struct(F.col(alt).alias("a"), F.col(prob).alias("p")), F.struct(F.col(prob), (-F.col(alt)).alias("t")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.a").alias("predicted"), F.col("b.p").alias("prob"))


def null_loglik(df: DataFrame, keys: list[str]) -> DataFrame:
    """Equal shares: sum of ln(1 / set size)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("j")).agg(F.count(F.lit(1)).alias("n_sets"), (-F.sum(F.log("j"))).alias("null_ll"))


def elasticity_at_mean(df: DataFrame, beta: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """beta * mean * (1 - P(mean)) per attribute; elastic above 1 in absolute value."""
    from .stats import inline
    m = df.agg(*[F.avg(c).alias(c) for c in beta])
    p = logistic_prob(linear(beta, intercept))
    rows = inline(m, [], [{"attribute": F.lit(c), "mean": F.col(c), "elasticity": F.lit(float(b)) * F.col(c) * (1 - p)}
                          for c, b in beta.items()])
    a = F.abs("elasticity")
    return rows.withColumn("kind", F.when(a > 1, "elastic").when(a < 1, "inelastic").otherwise("unit"))


def marginal_effects(df: DataFrame, prob: str, beta: dict[str, float]) -> DataFrame:
    """Average of P(1 - P) beta over the rows."""
    from .stats import inline
    w = F.avg(F.col(prob) * (1 - F.col(prob)))
    one = df.agg(w.alias("w"))
    return inline(one, [], [{"attribute": F.lit(c), "effect": F.col("w") * F.lit(float(b))} for c, b in beta.items()])
