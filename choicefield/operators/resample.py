"""Bootstrap: weights, refits, intervals, sign alignment.

A replicate is a table of integer weights (replicate, id, w); the data are never copied. Statistics that are sums
are first formed per individual, so a replicate adds individuals, not rows.
"""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import exact_quantiles, has_hot_group, ordered_scan
from ..functions.normal import norm_cdf, norm_ppf, two_sided_p, with_normals
from ..functions.scalars import count_if, hash_unit, safe_div
from ..functions.tails import t_two_sided
from ..session import stored
from . import kernels


SLOTS = 1 << 19  # slots that one task draws


def resample_weights(ids: DataFrame, key: str, replicates: int, seed: int, index: str = "idx") -> DataFrame:
    """(replicate, key, w): exact multinomial weights. Slot j of replicate b draws the individual with index
    floor(u(b, j) N).

    The numbered ids may lie in one task, so they are stored and spread before their slots are generated, and picks meet by
    index: a task draws and counts about ``SLOTS`` of them, however many there are. Picks look as small as the ids they come
    from, hence the merge hint: they are not to be broadcast."""
    ids = stored(ids.select(key, index), "ids")
    n = ids.count()
    parts = max(1, -(-n * replicates // SLOTS))
    slots = ids.select(F.col(index).alias("slot")).repartition(parts).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    picks = slots.select("replicate", F.floor(hash_unit(F.col("replicate"), F.col("slot"), F.lit(seed)) * n).cast("bigint").alias(index))
    counts = picks.repartition(parts, index).groupBy("replicate", index).agg(F.count("*").alias("w"))
    return counts.hint("merge").join(ids, index).select("replicate", key, "w")


def bootstrap_individuals(df: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """Cluster bootstrap: an individual drawn twice has weight 2 on all its rows."""
    return resample_weights(kernels.index_individuals(df, key), key, replicates, seed)


def bootstrap_rows(df: DataFrame, row_id: str, replicates: int, seed: int) -> DataFrame:
    """Row bootstrap: as above with the row id as the unit."""
    return resample_weights(kernels.index_individuals(df, row_id), row_id, replicates, seed)


def weighted_means(df: DataFrame, weights: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per replicate the means over the resampled rows: (replicate, parameter, value)."""
    from .stats import inline
    per = df.groupBy(key).agg(*[e for c in columns for e in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))])
    w = F.col("w").cast("double")
    wide = weights.hint("merge").join(per, key).groupBy("replicate").agg(*[safe_div(F.sum(w * F.col(f"s_{c}")), F.sum(w * F.col(f"n_{c}"))).alias(c) for c in columns])
    return inline(wide, ["replicate"], [{"parameter": F.lit(c), "value": F.col(c)} for c in columns])


def bootstrap_parametric(cov: DataFrame, items: list[str], replicates: int, seed: int) -> DataFrame:
    """Covariance rows of samples from N(0, S) of the fitted size: Bartlett's decomposition of the Wishart law, so a
    replicate costs p^2 numbers instead of n rows. ``cov``: rows (var1, var2, cov, n)."""
    schema = "replicate int, var1 string, var2 string, cov double, mean1 double, mean2 double, n bigint"
    p = len(items)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, n = int(pdf["replicate"].iloc[0]), int(pdf["n"].iloc[0])
        s = np.zeros((p, p))
        for x, y, v in zip(pdf["var1"], pdf["var2"], pdf["cov"]):
            s[items.index(x), items.index(y)] = s[items.index(y), items.index(x)] = v
        rng = np.random.default_rng([seed, b])
        a = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(n - 1 - np.arange(p))))
        la = np.linalg.cholesky(s) @ a
        w = la @ la.T / (n - 1)
        return pd.DataFrame([(b, items[i], items[j], w[i, j], 0.0, 0.0, n) for i in range(p) for j in range(i, p)],
                            columns=["replicate", "var1", "var2", "cov", "mean1", "mean2", "n"])
    each = cov.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return each.groupBy("replicate").applyInPandas(run, schema)


def bootstrap_stage1(df: DataFrame, key: str, factors: dict[str, list[str]], paths: list, weights: DataFrame) -> DataFrame:
    """Refit of the factor/path model per replicate from weighted covariances: one shuffle by replicate."""
    from ..estimators.latent import sem_fit
    return sem_fit(weights.hint("merge").join(df, key), factors, paths, ["replicate"], weight="w")


def bootstrap_stage2(rel: DataFrame, key: str, set_keys: list[str], start: dict[str, float], weights: DataFrame, scores: DataFrame | None = None,
                     products: dict[str, tuple[str, str]] | None = None, max_iter: int = 100) -> DataFrame:
    """Conditional logit per replicate: (replicate, parameter, value); a replicate that does not converge is NULL.

    ``rel`` is the difference design. All replicates take their Newton step in the same job: one aggregate by
    (replicate, set), one by replicate, then one k x k solve per replicate. Replicate-level factor scores
    (``scores``: replicate, key, columns) enter through ``products``: name -> (score, attribute).
    """
    names = list(start)
    products = products or {}
    level = StorageLevel.MEMORY_AND_DISK
    design, keys = kernels.cluster_by_individual(rel, key, set_keys)
    drawn = weights if scores is None else weights.join(scores, ["replicate", key])
    drawn = kernels.spread(drawn, keys).repartition(*keys).persist(level)
    design = design.persist(level)
    # rows meet their weights inside the partition of the individual in every step; replicates are never stored
    rows = design.join(drawn, keys).withColumn("w", F.col("w").cast("double"))
    rows = rows.withColumns({f"d_{n}": F.col(s) * F.col(f"d_{a}") for n, (s, a) in products.items()})
    spark = rel.sparkSession
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    theta = {r.replicate: np.array([start[a] for a in names]) for r in drawn.select("replicate").distinct().collect()}
    active, done, best, step = set(theta), {}, {}, {}
    kinds = "replicate int, " + ", ".join(f"b_{a} double" for a in names)
    for _ in range(max_iter):
        # one row of k numbers per replicate: the size is the number of replicates, not of the data
        betas = spark.createDataFrame([(int(b), *map(float, theta[b])) for b in sorted(active)], kinds)
        v = None
        for a in names:
            t = F.col(f"b_{a}") * F.col(f"d_{a}")
            v = t if v is None else v + t
        sets = kernels.exp_sums(
            rows.join(F.broadcast(betas), "replicate"), ["replicate", *dict.fromkeys([*keys, *set_keys])], v,
            {"s": F.lit(1.0)} | {f"t_{a}": F.col(f"d_{a}") for a in names} | {f"q_{a}_{b}": F.col(f"d_{a}") * F.col(f"d_{b}") for a, b in pairs},
            [F.max("w").alias("w")])
        g = {a: -F.col(f"t_{a}") / F.col("s") for a in names}
        one = sets.groupBy("replicate").agg(F.sum(-F.col("w") * (F.log("s") + F.col("__shift"))).alias("ll"), *[F.sum(F.col("w") * g[a]).alias(f"g_{a}") for a in names],
                                            *[F.sum(F.col("w") * (F.col(f"q_{a}_{b}") / F.col("s") - g[a] * g[b])).alias(f"i_{a}_{b}") for a, b in pairs])
        for r in one.collect():
            b = r.replicate
            grad = np.array([r[f"g_{a}"] for a in names])
            info = np.array([[r[f"i_{x}_{y}"] if names.index(x) <= names.index(y) else r[f"i_{y}_{x}"] for y in names] for x in names])
            if b in best and r.ll < best[b][0] - 1e-9:
                step[b] /= 2
                theta[b] = best[b][1] + step[b] * best[b][2]
                continue
            move = np.linalg.pinv(info) @ grad
            if grad @ move < 1e-8:
                done[b] = theta[b]
                active.discard(b)
                continue
            best[b], step[b] = (r.ll, theta[b], move), 1.0
            theta[b] = theta[b] + move
        if not active:
            break
    design.unpersist()
    drawn.unpersist()
    out = [(int(b), a, float(done[b][i]) if b in done else None) for b in theta for i, a in enumerate(names)]
    return spark.createDataFrame(out, "replicate int, parameter string, value double")


def bootstrap_both(items: DataFrame, rel: DataFrame, key: str, set_keys: list[str], factor: str, factor_items: list[str], attr: str,
                   start: dict[str, float], weights: DataFrame) -> DataFrame:
    """Both stages per replicate: refit the factor, score the individuals, z-score, refit the choice model with the
    score x attribute term ``<factor>_x_<attr>``."""
    weights = stored(weights, "weights")  # read by both stages; drawn once
    fits = bootstrap_stage1(items, key, {factor: factor_items}, [], weights)
    loads = fits.filter(F.col("lval").isin(factor_items) & (F.col("op") == "~")).select("replicate", F.col("lval").alias("item"), F.col("estimate").alias("loading"))
    wide = loads.groupBy("replicate").agg(*[F.max(F.when(F.col("item") == i, F.col("loading"))).alias(f"l_{i}") for i in factor_items])
    num, den = F.lit(0.0), F.lit(0.0)
    for i in factor_items:
        num, den = num + F.col(f"l_{i}") * F.col(i), den + F.col(f"l_{i}") * F.col(f"l_{i}")
    scored = weights.join(wide, "replicate").join(items.select(key, *factor_items), key).withColumn("__x", num / den)
    w = F.col("w").cast("double")
    m = scored.groupBy("replicate").agg((F.sum(w * F.col("__x")) / F.sum(w)).alias("mu"), (F.sum(w * F.col("__x") * F.col("__x")) / F.sum(w)).alias("m2"))
    z = scored.join(m, "replicate").select("replicate", key, safe_div(F.col("__x") - F.col("mu"), F.sqrt(F.greatest(F.col("m2") - F.col("mu") ** 2, F.lit(0.0)))).alias(factor))
    return bootstrap_stage2(rel, key, set_keys, start, weights, z, {f"{factor}_x_{attr}": (factor, attr)})


# ---- summaries over replicates -----------------------------------------------------------------------------

def bootstrap_ci(reps: DataFrame, keys: list[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """Percentile interval, mean, sd, zero-crossing p and significance."""
    a = (1 - level) / 2
    q = exact_quantiles(reps, keys, value, {"ci_low": a, "ci_high": 1 - a})
    v = F.col(value)
    m = reps.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                                count_if(v > 0).alias("n_pos"), count_if(v < 0).alias("n_neg"))
    n = F.col("n").cast("double")
    p = F.least(2 * F.least(safe_div(F.col("n_pos").cast("double"), n), safe_div(F.col("n_neg").cast("double"), n)), F.lit(1.0))
    return (m.withColumn("p_value", p).join(q, keys).drop("n_pos", "n_neg")
            .withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0)))


def bootstrap_ci_bc(reps: DataFrame, estimates: DataFrame, keys: list[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """Bias-corrected percentile interval around the original ``estimate``; the quantile levels depend on the data."""
    a = (1 - level) / 2
    counts = reps.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    j = reps.join(estimates.select(*keys, "estimate"), keys)
    below = j.groupBy(*keys).agg(F.count(value).alias("n"), count_if(F.col(value) < F.col("estimate")).alias("n_below"), F.max("estimate").alias("estimate"))
    n = F.col("n").cast("double")
    share = F.least(F.greatest(F.col("n_below") / n, 0.5 / n), 1 - 0.5 / n)
    below = with_normals(below, {"z0": share})
    zl, zh = norm_ppf(F.lit(a)), norm_ppf(F.lit(1 - a))
    below = below.withColumns({"__zl": 2 * F.col("z0") + zl, "__zh": 2 * F.col("z0") + zh})
    below = below.withColumns({"p_low": norm_cdf(F.col("__zl")), "p_high": norm_cdf(F.col("__zh"))}).drop("__zl", "__zh")
    cum = ordered_scan(counts, keys, [value], run_sum={"__cum": "__c"}, split=has_hot_group(reps, keys)).join(below, keys)
    picks = []
    for side in ("low", "high"):
        h = F.col(f"p_{side}") * (F.col("n") - 1)
        picks += [F.min(F.when(F.col("__cum") >= F.floor(h) + 1, F.col(value))).alias(f"lo_{side}"),
                  F.min(F.when(F.col("__cum") >= F.floor(h) + 2, F.col(value))).alias(f"hi_{side}"), F.max(h - F.floor(h)).alias(f"f_{side}")]
    out = cum.groupBy(*keys).agg(F.max("estimate").alias("estimate"), F.max("z0").alias("z0"), *picks)
    ci = lambda s: F.col(f"lo_{s}") + F.coalesce((F.col(f"hi_{s}") - F.col(f"lo_{s}")) * F.col(f"f_{s}"), F.lit(0.0))
    return out.select(*keys, "estimate", "z0", ci("low").alias("ci_low"), ci("high").alias("ci_high"))


def bootstrap_p(reps: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sign count (plain and +1), normal and t p-values of the mean over its bootstrap sd."""
    v = F.col(value)
    m = reps.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                                F.least(count_if(v <= 0), count_if(v >= 0)).alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    m = m.withColumns({"p_sign": F.least(2 * k / n, F.lit(1.0)), "p_sign_plus": F.least(2 * (k + 1) / (n + 1), F.lit(1.0)), "z": safe_div(F.col("mean"), F.col("sd"))})
    return m.withColumn("p_normal", two_sided_p(F.col("z"))).withColumn("p_t", t_two_sided("z", n - 1)).drop("k")


def bootstrap_stats(reps: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    m = reps.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"),
                                F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    return m.join(exact_quantiles(reps, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), keys)


def replicate_outcome(reps: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Requested, successful and failed (NULL) replicates."""
    return reps.groupBy(*keys).agg(F.count("*").alias("n_requested"), F.count(value).alias("n_success"), (F.count("*") - F.count(value)).alias("n_failed"))


# ---- sign and rotation -------------------------------------------------------------------------------------

def align_loadings(reference: DataFrame, reps: DataFrame, keys: list[str]) -> DataFrame:
    """Flip a replicate's factor when its loadings point against the reference: sum(l0 l) < 0."""
    ref = reference.select("factor", "item", F.col("loading").alias("__ref"))
    dot = reps.join(ref, ["factor", "item"]).groupBy(*keys, "factor").agg(F.sum(F.col("loading") * F.col("__ref")).alias("__dot"))
    j = reps.join(dot, [*keys, "factor"], "left")
    flip = F.coalesce(F.col("__dot") < 0, F.lit(False))
    return j.select(*keys, "factor", "item", F.when(flip, -F.col("loading")).otherwise(F.col("loading")).alias("loading"), flip.alias("flipped"))


def align_scores(reference: DataFrame, reps: DataFrame, keys: list[str], key: str, score: str) -> DataFrame:
    """Flip a replicate's scores when they correlate negatively with the reference scores."""
    ref = reference.select(key, F.col(score).alias("__ref"))
    r = reps.join(ref, key).groupBy(*keys).agg(F.corr(score, "__ref").alias("__r"))
    j = reps.join(r, keys, "left")
    flip = F.coalesce(F.col("__r") < 0, F.lit(False))
    return j.withColumn("flipped", flip).withColumn(score, F.when(flip, -F.col(score)).otherwise(F.col(score))).drop("__r")


def flip_stats(flips: DataFrame, factor: str, flipped: str, limit: float = 0.3) -> DataFrame:
    rate = F.avg(F.when(F.col(flipped), 1.0).otherwise(0.0))
    return flips.groupBy(factor).agg(F.count("*").alias("n"), count_if(F.col(flipped)).alias("n_flipped"), rate.alias("rate"), (rate > limit).alias("unstable"))


def procrustes_align(reference: DataFrame, reps: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """Orthogonal rotation of each replicate's loadings (keys, item, <factors>) onto the reference: the m x m cross
    products are sums in Spark, the m x m SVD is done per replicate."""
    ref = reference.select("item", *[F.col(f).alias(f"r_{f}") for f in factors])
    cross = reps.join(ref, "item").groupBy(*keys).agg(*[F.sum(F.col(a) * F.col(f"r_{b}")).alias(f"c_{a}_{b}") for a in factors for b in factors])
    kinds = ", ".join(f"{k} {cross.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"q_{a}_{b}" for a in factors for b in factors]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        u, _, vt = np.linalg.svd(np.array([[r[f"c_{a}_{b}"] for b in factors] for a in factors], dtype=float))
        return pd.DataFrame([[*[r[k] for k in keys], *(u @ vt).ravel()]], columns=[*keys, *names])
    turn = cross.groupBy(*keys).applyInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in names))
    j = reps.join(turn, keys)
    out = {}
    for b in factors:
        total = F.lit(0.0)
        for a in factors:
            total = total + F.col(a) * F.col(f"q_{a}_{b}")
        out[b] = total
    return j.select(*keys, "item", *[v.alias(f) for f, v in out.items()])


