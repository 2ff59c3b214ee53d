"""Effects along paths, mediation and moderation."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import exact_quantiles, with_group_values
from ..functions.normal import two_sided_p
from ..functions.scalars import safe_div
from .encode import _attach
from .leastsq import moments, solve, solved


def _edge(paths: DataFrame, keys: list[str], frm: str, to: str, est: str, se: str | None = None) -> DataFrame:
    cols = [F.col("rval").alias(frm), F.col("lval").alias(to), F.col("estimate").alias(est)]
    return paths.select(*keys, *cols, *([F.col("std_err").alias(se)] if se else []))


def effect_direct(paths: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return (_edge(paths, keys, "x", "y", "direct").filter((F.col("x") == x) & (F.col("y") == y)))


def effect_indirect(paths: DataFrame, keys: list[str], x: str, y: str, mediators: list[str]) -> DataFrame:
    """a * b per mediator."""
    a = _edge(paths, keys, "x", "m", "a").filter((F.col("x") == x) & F.col("m").isin(mediators))
    b = _edge(paths, keys, "m", "y", "b").filter((F.col("y") == y) & F.col("m").isin(mediators))
    return a.join(b, [*keys, "m"]).select(*keys, "x", "m", "y", "a", "b", (F.col("a") * F.col("b")).alias("indirect"))


def effect_total(paths: DataFrame, keys: list[str], x: str, y: str, mediators: list[str]) -> DataFrame:
    """direct + sum of indirect, and the share mediated; a missing direct path counts as 0."""
    ind = effect_indirect(paths, keys, x, y, mediators).groupBy(*keys).agg(F.sum("indirect").alias("indirect"))
    d = effect_direct(paths, keys, x, y).select(*keys, "direct")
    j = ind.join(d, keys, "full_outer").na.fill(0.0, ["indirect", "direct"])
    return j.withColumn("total", F.col("direct") + F.col("indirect")).withColumn("proportion_mediated", safe_div(F.col("indirect"), F.col("total")))


def effect_serial(paths: DataFrame, keys: list[str], x: str, y: str, mediators: list[str]) -> DataFrame:
    """a1 * d * b2 for every ordered mediator pair."""
    a = _edge(paths, keys, "x", "m1", "a").filter((F.col("x") == x) & F.col("m1").isin(mediators))
    d = _edge(paths, keys, "m1", "m2", "d").filter(F.col("m1").isin(mediators) & F.col("m2").isin(mediators) & (F.col("m1") != F.col("m2")))
    b = _edge(paths, keys, "m2", "y", "b").filter((F.col("y") == y) & F.col("m2").isin(mediators))
    j = a.join(d, [*keys, "m1"]).join(b, [*keys, "m2"])
    return j.select(*keys, "m1", "m2", (F.col("a") * F.col("d") * F.col("b")).alias("effect"))


def sobel(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Every x -> m -> y in the path table: a b, its standard error, z and p."""
    a = _edge(paths, keys, "x", "m", "a", "se_a")
    b = _edge(paths, keys, "m", "y", "b", "se_b")
    j = a.join(b, [*keys, "m"]).filter("x <> y")
    se = F.sqrt(F.col("b") ** 2 * F.col("se_a") ** 2 + F.col("a") ** 2 * F.col("se_b") ** 2)
    j = j.withColumn("indirect", F.col("a") * F.col("b")).withColumn("se", se).withColumn("z", safe_div(F.col("indirect"), F.col("se")))
    return j.select(*keys, "x", "m", "y", "indirect", "se", "z").withColumn("p_value", two_sided_p(F.col("z")))


def mediation_type(df: DataFrame, p_indirect: str, p_direct: str, alpha: float = 0.05) -> DataFrame:
    i, d = F.col(p_indirect) < alpha, F.col(p_direct) < alpha
    return df.withColumn("mediation", F.when(i & ~d, "full").when(i & d, "partial").otherwise("none"))


def mediation_sweep(paths: DataFrame, keys: list[str]) -> DataFrame:
    """All (x, m, y): direct, indirect, total, Sobel z and p, kind of mediation."""
    d = _edge(paths, keys, "x", "y", "direct", "se_d")
    j = sobel(paths, keys).join(d, [*keys, "x", "y"]).withColumn("z_direct", safe_div(F.col("direct"), F.col("se_d")))
    j = j.withColumn("p_direct", two_sided_p(F.col("z_direct"))).withColumn("total", F.col("direct") + F.col("indirect"))
    return mediation_type(j, "p_value", "p_direct").drop("se_d", "z_direct")


# ---- moderation ------------------------------------------------------------------------------------------

FIT_SCHEMA = "term string, estimate double, std_err double, cov_x_xm double, sigma2 double, r2 double, n bigint, m_mean double, m_sd double"


def moderation_fit(df: DataFrame, x: str, m: str, y: str, keys: list[str] = (), controls: list[str] = (), centre: bool = False) -> DataFrame:
    """y ~ 1 + x + m + x*m + controls per group: term (c, x, m, xm, <control>), estimate, std_err, z, p; one solve per group of moments.

    ``centre`` takes the means of x and m (over the group's complete rows) off before their product is formed: the slopes are then
    those at the mean. Terms that depend on others share their effect (``leastsq.solve``).
    """
    keys, controls = list(keys), list(controls)
    full = df.dropna(subset=[x, m, y, *controls])
    vx, vm = F.col(x).cast("double"), F.col(m).cast("double")
    if centre:
        full = with_group_values(full, keys, {"__mx": F.avg(x), "__mm": F.avg(m)}) if keys else _attach(full, full.agg(F.avg(x).alias("mx"), F.avg(m).alias("mm")))
        vx, vm = (vx - F.col("__mx"), vm - F.col("__mm")) if keys else (vx - F.col("__s.mx"), vm - F.col("__s.mm"))
    terms = {"c": F.lit(1.0), "x": vx, "m": vm, "xm": vx * vm} | {c: F.col(c) for c in controls}
    names, k = list(terms), len(terms)

    def rows(group, mm) -> list[tuple]:
        n = int(group["n"])
        b, cov, s2, rss, _ = solve(mm[:k, :k], mm[:k, k], mm[k, k], n)
        tss = mm[k, k] - mm[0, k] ** 2 / n
        return [(t, float(b[i]), float(math.sqrt(max(cov[i, i], 0.0))) if s2 == s2 else float("nan"), float(cov[1, 3]), s2, 1 - rss / tss if tss > 0 else None, n,
                 float(group["m_mean"]), float("nan") if group["m_sd"] is None else float(group["m_sd"])) for i, t in enumerate(names)]
    groups = moments(full, terms, F.col(y), keys, [F.avg(vm).alias("m_mean"), F.stddev_samp(vm).alias("m_sd")])
    fit = solved(groups, keys, k, rows, FIT_SCHEMA)
    return fit.withColumn("z", safe_div(F.col("estimate"), F.col("std_err"))).withColumn("p_value", two_sided_p(F.col("z")))


def moderation_interpret(fit: DataFrame, alpha: float = 0.05) -> DataFrame:
    b, p = F.col("estimate"), F.col("p_value")
    return fit.filter("term = 'xm'").withColumn("effect", F.when(p >= alpha, "none").when(b > 0, "strengthening").otherwise("weakening"))


def simple_slopes(fit: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Slope of x at mean - sd, mean, mean + sd of the moderator, with the covariance term in its standard error."""
    one = _slope_terms(fit, keys)
    levels = F.array(*[F.struct(F.lit(n).alias("level"), (F.col("m_mean") + F.lit(float(k)) * F.col("m_sd")).alias("m")) for n, k in (("low", -1), ("mean", 0), ("high", 1))])
    return _slopes(one.withColumn("l", F.explode(levels)).withColumns({"level": F.col("l.level"), "m": F.col("l.m")}), [*keys, "level"])


def conditional_effects(fit: DataFrame, df: DataFrame, m: str, probs=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Slope of x at percentiles of the moderator."""
    q = exact_quantiles(df, [], m, {f"p{round(p * 100)}": p for p in probs})
    one = _attach(_slope_terms(fit, []), q)
    levels = F.array(*[F.struct(F.lit(f"p{round(p * 100)}").alias("level"), F.col(f"__s.p{round(p * 100)}").alias("m")) for p in probs])
    return _slopes(one.withColumn("l", F.explode(levels)).withColumns({"level": F.col("l.level"), "m": F.col("l.m")}), ["level"])


def _slope_terms(fit: DataFrame, keys) -> DataFrame:
    pick = lambda t, c: F.max(F.when(F.col("term") == t, F.col(c)))
    return fit.groupBy(*keys).agg(pick("x", "estimate").alias("b1"), pick("xm", "estimate").alias("b3"), pick("x", "std_err").alias("s1"),
                                  pick("xm", "std_err").alias("s3"), F.max("cov_x_xm").alias("c13"), F.max("m_mean").alias("m_mean"), F.max("m_sd").alias("m_sd"))


def _slopes(df: DataFrame, keep) -> DataFrame:
    m = F.col("m")
    out = df.select(*keep, "m", (F.col("b1") + F.col("b3") * m).alias("slope"),
                    F.sqrt(F.col("s1") ** 2 + 2 * m * F.col("c13") + m * m * F.col("s3") ** 2).alias("se"))
    return out.withColumn("z", safe_div(F.col("slope"), F.col("se"))).withColumn("p_value", two_sided_p(F.col("z")))


def moderation_sweep(df: DataFrame, columns: list[str], controls: list[str] = ()) -> DataFrame:
    """Every (x, m, y): interaction estimate, p and n, given the ``controls``. All triples' moments come from one pass: x < m only,
    since the product is the same both ways round."""
    triples = [(x, m, y) for x, m, y in permutations(columns, 3) if x < m]
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(m).alias("m"), F.lit(y).alias("y"), F.col(x).cast("double").alias("vx"),
                              F.col(m).cast("double").alias("vm"), F.col(y).cast("double").alias("vy"),
                              *[F.col(c).cast("double").alias(f"w_{c}") for c in controls]) for x, m, y in triples])
    long = df.select(F.explode(rows).alias("t")).select("t.*")
    fit = moderation_fit(long, "vx", "vm", "vy", ["x", "m", "y"], [f"w_{c}" for c in controls]).filter("term = 'xm'").select("x", "m", "y", "estimate", "std_err", "p_value", "r2", "n")
    return fit.unionByName(fit.select(F.col("m").alias("x"), F.col("x").alias("m"), *fit.columns[2:]))
