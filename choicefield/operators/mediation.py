"""Mediation over all triples of variables, with bootstrap intervals: every replicate is a matrix of weighted moments.

The sums of products of all pairs of variables say everything about every x -> m -> y model. They are formed per replicate in one
aggregate over (replicate, individual, weight), so refitting p (p - 1) (p - 2) triples in B replicates reads the data once.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from .resample import bootstrap_ci, bootstrap_individuals

TINY = 1e-12


def weighted_covariances(df: DataFrame, weights: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(replicate, n, v): weighted population covariances of all pairs of columns, row by row."""
    w = F.col("w").cast("double")
    rows = weights.hint("merge").join(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]), key)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = rows.groupBy("replicate").agg(F.sum("w").alias("n"), *[F.sum(w * F.col(c)).alias(f"s_{i}") for i, c in enumerate(columns)],
                                         *[F.sum(w * F.col(a) * F.col(b)).alias(f"s_{columns.index(a)}_{columns.index(b)}") for a, b in pairs])
    n = F.col("n").cast("double")

    def cov(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return F.col(f"s_{i}_{j}") / n - F.col(f"s_{i}") / n * F.col(f"s_{j}") / n
    k = range(len(columns))
    return sums.select("replicate", "n", F.array(*[cov(i, j) for i in k for j in k]).alias("v"))


def triple_effects(cov: DataFrame, columns: list[str]) -> DataFrame:
    """(replicate, x, m, y, a, b, direct, indirect, total): m on x, and y on x and m, for every triple.

    Where x does not vary, or m is a multiple of x, the effects are NULL."""
    k = len(columns)
    triples = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x", "m", "y", "i", "j", "h"), (*t, *map(columns.index, t)))])
                                  for t in permutations(columns, 3)])).alias("t")
    at = lambda p, q: F.element_at("v", (F.col(f"t.{p}") * k + F.col(f"t.{q}") + 1).cast("int"))
    each = cov.select("replicate", "v", triples).select(
        "replicate", *[F.col(f"t.{c}").alias(c) for c in ("x", "m", "y")], at("i", "i").alias("xx"), at("i", "j").alias("xm"), at("j", "j").alias("mm"),
        at("i", "h").alias("xy"), at("j", "h").alias("my"))
    det = F.col("xx") * F.col("mm") - F.col("xm") * F.col("xm")
    varies = F.col("xx") > TINY
    free = varies & (det > TINY * F.col("xx") * F.col("mm"))
    fitted = each.select("replicate", "x", "m", "y", F.when(varies, safe_div(F.col("xm"), F.col("xx"))).alias("a"),
                         F.when(free, (F.col("xx") * F.col("my") - F.col("xm") * F.col("xy")) / det).alias("b"),
                         F.when(free, (F.col("mm") * F.col("xy") - F.col("xm") * F.col("my")) / det).alias("direct"),
                         F.when(varies, safe_div(F.col("xy"), F.col("xx"))).alias("total"))
    return fitted.select("replicate", "x", "m", "y", "a", "b", "direct", (F.col("a") * F.col("b")).alias("indirect"), "total")


def mediation_bootstrap(df: DataFrame, key: str, columns: list[str], replicates: int, seed: int, level: float = 0.95, effect: str = "indirect") -> DataFrame:
    """Every (x, m, y): the estimate of ``effect``, its percentile interval, whether that leaves out 0, and the failed replicates.

    ``df`` has one row per individual; rows with a missing value in ``columns`` are left out before they are drawn.
    """
    whole = df.select(key, *columns).dropna()
    weights = bootstrap_individuals(whole, key, replicates, seed)
    itself = whole.select(F.lit(0).alias("replicate"), key, F.lit(1).cast("bigint").alias("w"))
    effects = triple_effects(weighted_covariances(whole, weights.unionByName(itself), key, columns), columns)
    keys = ["x", "m", "y"]
    ci = bootstrap_ci(effects.filter("replicate > 0"), keys, effect, level)
    estimate = effects.filter("replicate = 0").select(*keys, F.col(effect).alias("estimate"))
    out = estimate.join(ci.select(*keys, "n", "mean", "sd", "ci_low", "ci_high", "significant"), keys, "left")
    return out.select(*keys, "estimate", "mean", "sd", "ci_low", "ci_high", F.coalesce("significant", F.lit(False)).alias("significant"),
                      (F.lit(replicates) - F.coalesce("n", F.lit(0))).cast("bigint").alias("n_failed"))


def mediation_rate(bootstrapped: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Tested and significant triples, and the share of the latter."""
    return bootstrapped.groupBy(*keys).agg(F.count("*").alias("n_tested"), F.count_if("significant").alias("n_significant"),
                                           F.avg(F.col("significant").cast("double")).alias("rate"))
