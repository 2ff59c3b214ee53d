"""Tables of estimated models: parameter tables, fit tables, comparisons between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import norm_ppf, two_sided_p
from ..functions.scalars import count_if, safe_div, signif_stars
from ..functions.tails import chi2_sf
from .shape import top_k


def model_table(results: DataFrame, run: str, alpha: float = 0.05) -> DataFrame:
    """Result rows (section, parameter, estimate, p_value) -> one row per run with LL, AIC, BIC and counts."""
    fit = lambda name: F.max(F.when((F.lower("section") == "model_fit") & (F.col("parameter") == name), F.col("estimate")))
    is_param = F.lower("section") == "parameters"
    return results.groupBy(run).agg(fit("LL").alias("ll"), fit("AIC").alias("aic"), fit("BIC").alias("bic"),
                                    count_if(is_param).alias("n_params"),
                                    count_if(is_param & (F.col("p_value") < alpha)).alias("n_significant"))


def models_by_complexity(models: DataFrame, groups: list[str]) -> DataFrame:
    return models.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_models"), F.avg("aic").alias("mean_aic"), F.min("aic").alias("min_aic"),
                                       F.avg("bic").alias("mean_bic"), F.min("bic").alias("min_bic"))


def lr_test(restricted: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """Nested runs paired on ``keys``: -2 (LL_r - LL_u) with the difference in parameters as degrees of freedom."""
    r = restricted.select(*keys, F.col("ll").alias("ll_r"), F.col("n_params").alias("k_r"))
    u = full.select(*keys, F.col("ll").alias("ll_u"), F.col("n_params").alias("k_u"))
    j = r.join(u, keys).withColumns({"lr": -2 * (F.col("ll_r") - F.col("ll_u")), "dof": F.col("k_u") - F.col("k_r")})
    return j.withColumn("p_value", chi2_sf("lr", F.col("dof").cast("double")))


def rank_models(models: DataFrame, criterion: str, run: str, n: int) -> DataFrame:
    """Best n models with their rank; the rank is numbered on the n kept rows only."""
    from pyspark.sql import Window
    best = top_k(models, [criterion, run], n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(criterion), F.col(run))))


def path_summary(paths: DataFrame, target: str, estimate: str, p: str, alpha: float = 0.05) -> DataFrame:
    return paths.groupBy(target).agg(F.count(F.lit(1)).alias("n_paths"), F.avg(estimate).alias("mean"),
                                     F.stddev_samp(estimate).alias("sd"), count_if(F.col(p) < alpha).alias("n_significant"))


def factor_effect_lookup(paths: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Named path coefficients: ``wanted`` holds (from_var, to_var, alias)."""
    p = paths.select(*keys, F.col("rval").alias("from_var"), F.col("lval").alias("to_var"), "estimate")
    return p.join(wanted, ["from_var", "to_var"]).select(*keys, "alias", "estimate")


def t_and_p(df: DataFrame, estimate: str, se: str) -> DataFrame:
    return (df.withColumn("t", safe_div(F.col(estimate), F.col(se)))
            .withColumn("p_value", two_sided_p(F.col("t"))))


def coef_table(df: DataFrame, estimate: str, se: str, level: float = 0.95) -> DataFrame:
    """estimate, se, z, p, confidence interval, stars."""
    q = norm_ppf(F.lit(0.5 + level / 2))
    out = t_and_p(df, estimate, se).withColumnRenamed("t", "z")
    return out.withColumns({"ci_low": F.col(estimate) - q * F.col(se), "ci_high": F.col(estimate) + q * F.col(se),
                            "stars": signif_stars(F.col("p_value"))})


def odds_ratios(df: DataFrame, estimate: str, se: str, level: float = 0.95) -> DataFrame:
    q = norm_ppf(F.lit(0.5 + level / 2))
    b, s = F.col(estimate), F.col(se)
    text = F.when(b > 0, "increases").when(b < 0, "decreases").otherwise("no effect")
    return df.withColumns({"odds_ratio": F.exp(b), "or_low": F.exp(b - q * s), "or_high": F.exp(b + q * s), "direction": text})


def coef_interpretation(df: DataFrame, estimate: str, p: str, alpha: float = 0.05) -> DataFrame:
    b, sig = F.col(estimate), F.col(p) < alpha
    return df.withColumns({"direction": F.when(b > 0, "positive").when(b < 0, "negative").otherwise("none"),
                           "significant": sig, "stars": signif_stars(F.col(p)),
                           "reading": F.when(sig & (b > 0), "raises choice").when(sig & (b < 0), "lowers choice")
                           .otherwise("no significant effect")})


def wtp(coefs: DataFrame, keys: list[str], parameter: str, estimate: str, price: str) -> DataFrame:
    """-beta / beta_price for every other parameter of the same model; NULL when the price coefficient is 0."""
    p = coefs.filter(F.col(parameter) == price).select(*keys, F.col(estimate).alias("__price"))
    return (coefs.filter(F.col(parameter) != price).join(p, keys)
            .select(*keys, parameter, safe_div(-F.col(estimate), F.col("__price")).alias("wtp")))


def fit_statistics(df: DataFrame, ll: str, n_params: str, n_sets: str, null_ll: str) -> DataFrame:
    """AIC, BIC, rho^2 and adjusted rho^2 as columns."""
    k, v = F.col(n_params), F.col(ll)
    return df.withColumns({"aic": -2 * v + 2 * k, "bic": -2 * v + k * F.log(F.col(n_sets)),
                           "rho2": 1 - safe_div(v, F.col(null_ll)), "adj_rho2": 1 - safe_div(v - k, F.col(null_ll))})
