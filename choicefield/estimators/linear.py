"""Least squares from moments: one aggregate over the data, a k x k solve afterwards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from ..operators import blocks
from ..operators.leastsq import solve
from ..operators.models import coef_table


def ols(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """(parameter, estimate, std_error, z, p_value, ci, stars, sigma2, r2, n); many columns are summed as Gram blocks."""
    names = (["const"] if intercept else []) + list(xs)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*xs, y])]).dropna().withColumns({"const": F.lit(1.0), "__n": F.lit(1.0)})
    m = blocks.gram(data, [*names, y, "__n"])
    k, n = len(names), int(round(m[-1, -1]))
    b, cov, s2, rss, _ = solve(m[:k, :k], m[:k, k], m[k, k], n)
    tss = m[k, k] - m[k, -1] ** 2 / n if n else 0.0
    rows = [(nm, float(v), float(np.sqrt(max(cov[i, i], 0.0))), float(s2), float(1 - rss / tss) if tss > 0 else None, n) for i, (nm, v) in enumerate(zip(names, b))]
    out = df.sparkSession.createDataFrame(rows, "parameter string, estimate double, std_error double, sigma2 double, r2 double, n bigint")
    return coef_table(out, "estimate", "std_error")


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix; infinite when R^2 >= .9999."""
    full = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = full.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs]).first()
    r = np.eye(len(columns))
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        r[i, j] = r[j, i] = row[f"{a}__{b}"]
    d = np.diag(np.linalg.pinv(r)) if np.linalg.matrix_rank(r) < len(columns) else np.diag(np.linalg.inv(r))
    rows = [(c, float("inf") if v < 1 or 1 - 1 / v >= 0.9999 else float(v)) for c, v in zip(columns, d)]
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")


def fit_linear_component(df: DataFrame, attr: str, outcome: str) -> DataFrame:
    """Slope of the outcome on one attribute."""
    x, y = F.col(attr), F.col(outcome).cast("double")
    return df.agg(F.regr_slope(y, x).alias("coefficient"))


def fit_corr_component(df: DataFrame, attr: str, outcome: str) -> DataFrame:
    return df.agg(F.corr(F.col(attr).cast("double"), F.col(outcome).cast("double")).alias("coefficient"))


def fit_product_component(df: DataFrame, attrs: list[str], outcome: str) -> DataFrame:
    """Slope on a product of attributes, with the share of rows where the product is not 0."""
    p = F.lit(1.0)
    for a in attrs:
        p = p * F.col(a)
    y = F.col(outcome).cast("double")
    return df.agg(F.regr_slope(y, p).alias("coefficient"),
                  safe_div(F.count(F.when(p != 0, 1)).cast("double"), F.count(p)).alias("non_zero_rate"))
