"""Least squares from moments: sums of products per group in one partially combined aggregate, then a k x k solve per group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def solve(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """(coefficients, covariance, sigma^2, residual sum of squares, rank) of y on x.

    With dependent columns the coefficients are those of least norm and the covariance is that of what is identified; the
    residual variance divides by n - rank and is NaN without a degree of freedom left.
    """
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))  # columns on one scale, so that the rank is about dependence
    inv = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-12 * len(xx), hermitian=True))
    b = inv @ xy
    rss = max(float(yy - b @ xy), 0.0)
    s2 = rss / (n - rank) if n > rank else float("nan")
    return b, s2 * inv, s2, rss, rank


def moments(df: DataFrame, terms: dict[str, Column], y: Column, keys: list[str] = (), extra: list[Column] = ()) -> DataFrame:
    """One row per group: n, ``extra`` aggregates and xx, the sums of products of the terms and y (upper triangle, row by row).

    Rows where a term or y is NULL are left out."""
    names = [*[f"__t{i}" for i in range(len(terms))], "__y"]
    rows = df.withColumns(dict(zip(names, [*[c.cast("double") for c in terms.values()], y.cast("double")]))).dropna(subset=names)
    products = F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), products.alias("xx"), *extra)


def full_matrix(xx, k: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle, row by row."""
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = xx
    return m + np.triu(m, 1).T


def solved(groups: DataFrame, keys: list[str], k: int, rows: Callable[[pd.Series, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """``rows(group, m)`` for every row of ``moments``, m being the (k + 1) x (k + 1) products of the terms and y."""
    kinds = "".join(f"`{c}` {groups.schema[c].dataType.simpleString()}, " for c in keys)
    names = [*keys, *[c.strip().split()[0] for c in schema.split(",")]]

    def run(frames):
        for pdf in frames:
            out = [(*[r[c] for c in keys], *s) for _, r in pdf.iterrows() if r["n"] for s in rows(r, full_matrix(r["xx"], k + 1))]
            yield pd.DataFrame(out, columns=names)
    return groups.mapInPandas(run, kinds + schema)
