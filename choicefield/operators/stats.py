"""Descriptive statistics, correlations, reliability, validity and effect tables.

Everything is one (or a fixed number of) partially combined aggregates over the data.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import exact_quantiles, first_n, has_hot_group, ordered_scan
from ..functions.scalars import add, count_if, safe_div
from ..functions.tails import chi2_sf, t_two_sided
from .encode import _attach, bin_tertile

ONE = "*"


def inline(df: DataFrame, keys: list[str], rows: list[dict[str, Column]]) -> DataFrame:
    """Turn named expressions of a wide aggregate into rows (name -> value per row)."""
    structs = F.array(*[F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows])
    return df.select(*keys, F.explode(structs).alias("r")).select(*keys, "r.*")


def long_agg(df: DataFrame, columns: list[str], stats: dict, keys: list[str] = (), label: str = "column_name") -> DataFrame:
    """``stats``: output name -> function(column name) -> aggregate. One pass, one row per column."""
    keys = list(keys)
    wide = df.groupBy(*keys).agg(*[f(c).alias(f"{s}__{c}") for c in columns for s, f in stats.items()])
    return inline(wide, keys, [{label: F.lit(c), **{s: F.col(f"{s}__{c}") for s in stats}} for c in columns])


# ---- shares and simple tables ----------------------------------------------------------------------------

def choice_share(long: DataFrame, level: str, chosen: str) -> DataFrame:
    per = long.groupBy(level).agg(F.sum(chosen).alias("n_chosen"))
    return per.withColumn("share", safe_div(F.col("n_chosen").cast("double"), per.agg(F.sum("n_chosen")).scalar()))


def chosen_by_level(long: DataFrame, level: str, chosen: str, opt_out: Column) -> DataFrame:
    return (long.filter(~opt_out & (F.col(chosen) == 1)).groupBy(level).agg(F.count(ONE).alias("n_chosen")))


def choice_rate_by_level(long: DataFrame, level: str, chosen: str) -> DataFrame:
    return long.groupBy(level).agg(F.count(ONE).alias("n_shown"), F.avg(chosen).alias("rate"))


def chi2_independence(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Chi-square, degrees of freedom and p of a contingency table (only counts, whatever the data size).

    Sum of n_ij^2 / (n_i n_j) * n - n, which also covers empty cells."""
    cells = df.groupBy(rows, columns).agg(F.count(ONE).alias("n"))
    r = cells.groupBy(rows).agg(F.sum("n").alias("nr"))
    c = cells.groupBy(columns).agg(F.sum("n").alias("nc"))
    joined = cells.join(r, rows).join(c, columns)
    out = joined.agg(F.sum(F.col("n") * F.col("n") / (F.col("nr").cast("double") * F.col("nc"))).alias("s"),
                     F.sum("n").alias("n"), F.countDistinct(rows).alias("i"), F.countDistinct(columns).alias("j"))
    out = out.select("n", ((F.col("s") - 1) * F.col("n")).alias("chi2"),
                     ((F.col("i") - 1) * (F.col("j") - 1)).alias("dof"))
    return out.withColumn("p_value", chi2_sf("chi2", F.col("dof").cast("double")))


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean, sd, min, max and exact distinct count per column.

    Distinct counts come from (column, value) pairs, one shuffle for all columns together.
    """
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = d.unpivot([], columns, "column_name", "v").filter("v is not null").groupBy("column_name", "v").agg(F.count(ONE).alias("c"))
    distinct = pairs.groupBy("column_name").agg(F.count(ONE).alias("n_distinct"))
    moments = long_agg(d, columns, {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max})
    return moments.join(distinct, "column_name", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def choice_data_summary(df: DataFrame, key: str, chosen: str, binary: list[str], price: str) -> DataFrame:
    return df.agg(F.countDistinct(key).alias("n_ids"), F.count(ONE).alias("n_rows"), F.sum(chosen).cast("bigint").alias("n_chosen"),
                  *[F.avg(b).alias(f"{b}_rate") for b in binary], F.avg(price).alias("price_mean"),
                  F.stddev_samp(price).alias("price_sd"), F.min(price).alias("price_min"), F.max(price).alias("price_max"))


def design_balance(design: DataFrame, attrs: list[str]) -> DataFrame:
    """Counts of every level and of every pair of levels: (attribute, level, n)."""
    combos = [(a,) for a in attrs] + list(combinations(attrs, 2))
    rows = F.array(*[F.struct(F.lit(" x ".join(c)).alias("attribute"),
                              F.concat_ws(" x ", *[F.col(a).cast("string") for a in c]).alias("level"),
                              add([F.col(a).isNull().cast("int") for a in c]).alias("nulls")) for c in combos])
    return (design.select(F.explode(rows).alias("r")).filter("r.nulls = 0")
            .groupBy("r.attribute", "r.level").agg(F.count(ONE).alias("n")))


def distribution_profile(df: DataFrame, column: str, probs=(0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)) -> DataFrame:
    """Moments (population skewness, excess kurtosis) and exact percentiles, one row."""
    x = F.col(column)
    m = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"),
               F.max(x).alias("max"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    q = exact_quantiles(df, [], column, {f"p{round(p * 100):02d}": p for p in probs})
    return _attach(m, q).select(*m.columns, "__s.*")


def normality_test(df: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """Jarque-Bera on all rows."""
    m = df.agg(F.count(column).alias("n"), F.skewness(column).alias("skewness"), F.kurtosis(column).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return (m.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2))
            .withColumn("is_normal", F.col("p_value") > alpha))


def quantiles(df: DataFrame, keys: list[str], column: str, probs: list[float]) -> DataFrame:
    return exact_quantiles(df, keys, column, {f"q{round(p * 1000):04d}": p for p in probs})


# ---- correlations ----------------------------------------------------------------------------------------

def corr_pairs(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str] = ()) -> DataFrame:
    """(var1, var2, r, n), pairwise complete, all pairs in one pass."""
    keys = list(keys)
    both = lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    wide = df.groupBy(*keys).agg(*[e for i, (a, b) in enumerate(pairs) for e in (
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}"), both(a, b).alias(f"n{i}"))])
    return inline(wide, keys, [{"var1": F.lit(a), "var2": F.lit(b), "r": F.col(f"r{i}"), "n": F.col(f"n{i}")}
                               for i, (a, b) in enumerate(pairs)])


def corr_matrix(df: DataFrame, columns: list[str], key: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Upper triangle. With ``key`` the table is first reduced to the first row per individual along ``order``."""
    grain = df if key is None else first_n(df.select(key, *dict.fromkeys([*[o.lstrip("-") for o in order], *columns])),
                                           [key], order, 1)
    return corr_pairs(grain, list(combinations(columns, 2)))


def corr_block(df: DataFrame, left: list[str], right: list[str], key: str | None = None,
               order: list[str] | None = None) -> DataFrame:
    """Rectangular block left x right."""
    need = list(dict.fromkeys([*left, *right]))
    grain = df if key is None else first_n(df.select(key, *dict.fromkeys([*[o.lstrip("-") for o in order], *need])),
                                           [key], order, 1)
    return corr_pairs(grain, [(a, b) for a in left for b in right])


def corr_significance(corr: DataFrame) -> DataFrame:
    """Adds t and the two-sided p of each correlation."""
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.when(F.abs("r") < 1, 1 - F.col("r") * F.col("r")))
    return (corr.withColumn("t", F.when(F.col("n") > 2, t))
            .withColumn("p_value", t_two_sided("t", (F.col("n") - 2).cast("double"))))


def corr_summary(corr: DataFrame) -> DataFrame:
    """Counts of strong (> .5), moderate (> .3) and weak pairs and the strongest |r|."""
    a = F.abs("r")
    return corr.agg(F.count(ONE).alias("n_pairs"), count_if(a > 0.5).alias("n_strong"),
                    count_if((a > 0.3) & (a <= 0.5)).alias("n_moderate"), count_if(a <= 0.3).alias("n_weak"),
                    F.max(a).alias("max_abs_r"), F.max_by(F.concat_ws("~", "var1", "var2"), a).alias("strongest"))


# ---- factor scores ---------------------------------------------------------------------------------------

def factor_score_loading(items_long: DataFrame, loadings: DataFrame, key: str) -> DataFrame:
    """sum(loading * value) / sum(loading^2) per individual and factor, over the answered items."""
    j = items_long.join(loadings.select("factor", "item", "loading"), ["factor", "item"]).filter("value is not null")
    lam = F.col("loading")
    return j.groupBy(key, "factor").agg(safe_div(F.sum(lam * F.col("value")), F.sum(lam * lam)).alias("score"))


def score_variance_check(df: DataFrame, scores: list[str], floor: float = 0.01) -> DataFrame:
    out = long_agg(df, scores, {"mean": F.avg, "variance": F.var_pop, "sd": F.stddev_pop, "min": F.min, "max": F.max},
                   label="factor")
    return out.withColumn("too_small", F.col("variance") < floor)


def score_summary(df: DataFrame, column: str) -> DataFrame:
    m = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"),
               F.min(column).alias("min"), F.max(column).alias("max"))
    q = exact_quantiles(df, [], column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return _attach(m, q).select(*m.columns, "__s.*")


def factor_effects_summary(df: DataFrame, score: str, chosen: str, binary: list[str], level: str) -> DataFrame:
    """(statistic, level, value): score moments, r with choice, mean score by attribute level, choice rate by score level."""
    s = F.col(score)
    wide = df.agg(F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), F.corr(s, F.col(chosen).cast("double")).alias("r_choice"),
                  *[F.avg(F.when(F.col(b) == v, s)).alias(f"{b}__{v}") for b in binary for v in (0, 1)])
    rows = [{"statistic": F.lit(n), "level": F.lit(""), "value": F.col(n)} for n in ("mean", "sd", "r_choice")]
    rows += [{"statistic": F.lit(f"mean_by_{b}"), "level": F.lit(str(v)), "value": F.col(f"{b}__{v}")} for b in binary for v in (0, 1)]
    by_level = df.filter(F.col(level).isNotNull()).groupBy(level).agg(F.avg(chosen).alias("value")).select(
        F.lit("choice_rate").alias("statistic"), F.col(level).alias("level"), "value")
    return inline(wide, [], rows).unionByName(by_level)


# ---- reliability and validity ----------------------------------------------------------------------------

def cronbach_alpha(df: DataFrame, factors: dict[str, list[str]]) -> DataFrame:
    """k/(k-1) (1 - sum of item variances / variance of the sum), listwise within each factor; one pass."""
    exprs, rows = [], []
    for f, items in factors.items():
        total = add([F.col(i).cast("double") for i in items])
        exprs += [F.var_samp(F.when(total.isNotNull(), F.col(i))).alias(f"{f}__{i}") for i in items]
        exprs += [F.var_samp(total).alias(f"{f}__total"), F.count(total).alias(f"{f}__n")]
        k = len(items)
        alpha = F.lit(k / (k - 1)) * (1 - safe_div(add([F.col(f"{f}__{i}") for i in items]), F.col(f"{f}__total")))
        rows.append({"factor": F.lit(f), "n_items": F.lit(k), "n": F.col(f"{f}__n"), "alpha": alpha})
    return inline(df.agg(*exprs), [], rows)


def item_total_loadings(df: DataFrame, factors: dict[str, list[str]]) -> DataFrame:
    """Loadings (factor, item, loading) as the correlation of an item with its factor's item sum."""
    exprs, rows = [], []
    for f, items in factors.items():
        total = add([F.col(i).cast("double") for i in items])
        for i in items:
            exprs.append(F.corr(F.col(i).cast("double"), total).alias(f"{f}__{i}"))
            rows.append({"factor": F.lit(f), "item": F.lit(i), "loading": F.col(f"{f}__{i}")})
    return inline(df.agg(*exprs), [], rows)


def composite_reliability(loadings: DataFrame, keys: list[str] = ("factor",)) -> DataFrame:
    lam = F.col("loading")
    s, e = F.sum(lam), F.sum(1 - lam * lam)
    return loadings.groupBy(*keys).agg(safe_div(s * s, s * s + e).alias("cr"))


def ave(loadings: DataFrame, keys: list[str] = ("factor",)) -> DataFrame:
    lam = F.col("loading")
    q, e = F.sum(lam * lam), F.sum(1 - lam * lam)
    return loadings.groupBy(*keys).agg(safe_div(q, q + e).alias("ave"), F.sqrt(safe_div(q, q + e)).alias("sqrt_ave"))


def reliability_table(df: DataFrame, factors: dict[str, list[str]], loadings: DataFrame) -> DataFrame:
    lam = F.col("loading")
    load = loadings.groupBy("factor").agg(F.avg(lam).alias("mean_loading"), F.min(lam).alias("min_loading"), F.max(lam).alias("max_loading"))
    out = cronbach_alpha(df, factors).join(composite_reliability(loadings), "factor").join(ave(loadings), "factor").join(load, "factor")
    return out.withColumns({"alpha_ok": F.col("alpha") >= 0.7, "cr_ok": F.col("cr") >= 0.7, "ave_ok": F.col("ave") >= 0.5})


def fornell_larcker(corr: DataFrame, ave_table: DataFrame) -> DataFrame:
    """Per factor pair: |r| against the smaller sqrt(AVE)."""
    a1 = ave_table.select(F.col("factor").alias("var1"), F.col("sqrt_ave").alias("sqrt_ave_1"))
    a2 = ave_table.select(F.col("factor").alias("var2"), F.col("sqrt_ave").alias("sqrt_ave_2"))
    low = F.least("sqrt_ave_1", "sqrt_ave_2")
    return (corr.select("var1", "var2", F.abs("r").alias("abs_r")).join(a1, "var1").join(a2, "var2")
            .select("var1", "var2", "abs_r", "sqrt_ave_1", "sqrt_ave_2", low.alias("min_sqrt_ave"),
                    (F.col("abs_r") < low).alias("valid"), (low - F.col("abs_r")).alias("margin")))


def validity_summary(fl: DataFrame) -> DataFrame:
    ok = count_if(F.col("valid"))
    return fl.agg(F.count(ONE).alias("n_pairs"), ok.alias("n_valid"), (F.count(ONE) - ok).alias("n_invalid"),
                  safe_div(ok.cast("double"), F.count(ONE)).alias("rate"), (ok == F.count(ONE)).alias("overall"))


def validity_matrix(corr: DataFrame, ave_table: DataFrame, factors: list[str]) -> DataFrame:
    """sqrt(AVE) on the diagonal, r off it; one column per factor."""
    diag = ave_table.select(F.col("factor").alias("var1"), F.col("factor").alias("var2"), F.col("sqrt_ave").alias("v"))
    upper = corr.select("var1", "var2", F.col("r").alias("v"))
    lower = corr.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), F.col("r").alias("v"))
    cells = diag.unionByName(upper).unionByName(lower)
    return cells.groupBy(F.col("var1").alias("factor")).pivot("var2", factors).agg(F.first("v"))


def htmt(df: DataFrame, factors: dict[str, list[str]]) -> DataFrame:
    """Heterotrait-monotrait ratio per factor pair: mean |r| across / geometric mean of the means within."""
    factor_of = {i: f for f, items in factors.items() for i in items}
    pairs = list(combinations(factor_of, 2))
    where = F.create_map(*[F.lit(x) for kv in factor_of.items() for x in kv])
    c = corr_pairs(df, pairs).withColumns({"f1": where[F.col("var1")], "f2": where[F.col("var2")]})
    m = c.groupBy("f1", "f2").agg(F.avg(F.abs("r")).alias("m"))
    mono = m.filter("f1 = f2")
    m1 = mono.select("f1", F.col("m").alias("m1"))
    m2 = mono.select("f2", F.col("m").alias("m2"))
    out = m.filter("f1 <> f2").join(m1, "f1").join(m2, "f2")
    ratio = safe_div(F.col("m"), F.sqrt(F.col("m1") * F.col("m2")))
    return out.select("f1", "f2", ratio.alias("htmt"), (ratio < 0.85).alias("valid"))


def mean_diff_by_choice(df: DataFrame, columns: list[str], chosen: str) -> DataFrame:
    y = F.col(chosen)
    out = long_agg(df, columns, {"mean_chosen": lambda c: F.avg(F.when(y == 1, F.col(c))),
                                 "mean_not_chosen": lambda c: F.avg(F.when(y == 0, F.col(c)))}, label="variable")
    return out.withColumn("difference", F.col("mean_chosen") - F.col("mean_not_chosen"))


def scale_profile(df: DataFrame, columns: list[str], tol: float = 0.1) -> DataFrame:
    """Mean and sd side by side; standardised when |mean| and |sd - 1| are within ``tol``."""
    out = long_agg(df, columns, {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}, label="variable")
    return out.withColumn("standardised", (F.abs("mean") < tol) & (F.abs(F.col("sd") - 1) < tol))


# ---- attribute effects -----------------------------------------------------------------------------------

def attr_effect_binary(df: DataFrame, attr: str, outcome: str) -> DataFrame:
    """Group sizes, means and sds, Cohen's d and the pooled t-test."""
    y = F.col(outcome)
    g = {v: F.when(F.col(attr) == v, y) for v in (0, 1)}
    m = df.agg(*[e for v in (0, 1) for e in (F.count(g[v]).alias(f"n{v}"), F.avg(g[v]).alias(f"mean{v}"),
                                             F.stddev_samp(g[v]).alias(f"sd{v}"))])
    pooled = F.sqrt(safe_div((F.col("n0") - 1) * F.col("sd0") ** 2 + (F.col("n1") - 1) * F.col("sd1") ** 2,
                             F.col("n0") + F.col("n1") - 2))
    m = m.withColumn("difference", F.col("mean1") - F.col("mean0")).withColumn("pooled_sd", pooled)
    m = m.withColumn("cohens_d", safe_div(F.col("difference"), F.col("pooled_sd")))
    m = m.withColumn("t", safe_div(F.col("difference"), F.col("pooled_sd") * F.sqrt(1 / F.col("n0") + 1 / F.col("n1"))))
    return m.withColumn("p_value", t_two_sided("t", (F.col("n0") + F.col("n1") - 2).cast("double")))


def attr_effect_continuous(df: DataFrame, attr: str, outcome: str) -> DataFrame:
    """r, slope, intercept and R^2."""
    x, y = F.col(attr), F.col(outcome)
    return df.agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.count(ONE).alias("n"))


def quartile_effects(df: DataFrame, attr: str, outcome: str) -> DataFrame:
    """n, mean and sd of the outcome by attribute quartile."""
    q = bin_tertile(df, attr, "quartile", (0.25, 0.5, 0.75), ("Q1", "Q2", "Q3", "Q4"))
    return (q.filter(F.col("quartile").isNotNull()).groupBy("quartile")
            .agg(F.count(ONE).alias("n"), F.avg(outcome).alias("mean"), F.stddev_samp(outcome).alias("sd")))


def preference_stats(df: DataFrame, attr: str, chosen: str) -> DataFrame:
    a, y = F.col(attr), F.col(chosen)
    return df.agg(F.avg(a).alias("attribute_rate"), F.avg(F.when(a == 1, y)).alias("choice_rate_with"),
                  F.avg(F.when(a == 0, y)).alias("choice_rate_without"))


def price_sensitivity_stats(df: DataFrame, price: str, chosen: str) -> DataFrame:
    p, y = F.col(price), F.col(chosen)
    return df.agg(F.avg(p).alias("mean"), F.stddev_samp(p).alias("sd"), F.min(p).alias("min"), F.max(p).alias("max"),
                  F.avg(F.when(y == 1, p)).alias("mean_chosen"), F.avg(F.when(y == 0, p)).alias("mean_not_chosen"),
                  F.corr(p, y.cast("double")).alias("r_choice"))


def interaction_stats(df: DataFrame, x: str, z: str, chosen: str) -> DataFrame:
    """Moments of x*z, non-zero rate, r with choice, and choice rates of the 2x2 cells."""
    p, y = F.col(x) * F.col(z), F.col(chosen)
    cell = lambda a, b: F.avg(F.when((F.col(x) == a) & (F.col(z) == b), y))
    return df.agg(F.avg(p).alias("mean"), F.stddev_samp(p).alias("sd"), F.min(p).alias("min"), F.max(p).alias("max"),
                  F.avg(F.when(p != 0, 1.0).otherwise(0.0)).alias("non_zero_rate"),
                  F.corr(p.cast("double"), y.cast("double")).alias("r_choice"),
                  cell(1, 1).alias("both_on"), cell(1, 0).alias("first_only"), cell(0, 1).alias("second_only"), cell(0, 0).alias("neither"))


def choice_rate_by_tertile(df: DataFrame, score: str, chosen: str, attrs: list[str]) -> DataFrame:
    b = bin_tertile(df, score, "tertile")
    return b.filter(F.col("tertile").isNotNull()).groupBy("tertile").agg(
        F.count(chosen).alias("n"), F.avg(chosen).alias("choice_rate"), *[F.avg(a).alias(f"{a}_preference") for a in attrs])


def elasticity_by_segment(df: DataFrame, segment: str, price: str, chosen: str, min_rows: int = 10) -> DataFrame:
    return (df.groupBy(segment).agg(F.count(ONE).alias("n"), F.corr(price, F.col(chosen).cast("double")).alias("r"))
            .filter(F.col("n") > min_rows))


# ---- predictions -----------------------------------------------------------------------------------------

def confusion_matrix(df: DataFrame, actual: str, prob: str, threshold: float = 0.5) -> DataFrame:
    hit, y = F.col(prob) >= threshold, F.col(actual) == 1
    m = df.agg(count_if(hit & y).alias("tp"), count_if(hit & ~y).alias("fp"), count_if(~hit & y).alias("fn"),
               count_if(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return m.withColumns({"accuracy": safe_div(tp + tn, tp + tn + fp + fn), "precision": safe_div(tp, tp + fp),
                          "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn)})


def auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """ROC AUC: positives and negatives per distinct score, then negatives below each score (half for ties)."""
    per = df.groupBy(score).agg(count_if(F.col(actual) == 1).alias("pos"), count_if(F.col(actual) == 0).alias("neg"))
    cum = ordered_scan(per, [], [score], run_sum={"upto": "neg"}, split=has_hot_group(df, []))
    won = F.col("pos").cast("double") * (F.col("upto") - F.col("neg") / 2)
    return cum.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                   safe_div(F.sum(won), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def component_stats(df: DataFrame, components: list[str], total: str) -> DataFrame:
    out = long_agg(df, components, {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max, "variance": F.var_samp,
                                    "tv": lambda _: F.var_samp(total)}, label="component")
    return out.select("component", "mean", "sd", "min", "max", (F.col("max") - F.col("min")).alias("range"),
                      safe_div(F.col("sd"), F.abs("mean")).alias("cv"), safe_div(F.col("variance"), F.col("tv")).alias("variance_share"))


def component_importance(df: DataFrame, components: list[str]) -> DataFrame:
    """Mean share of |component| in the row's sum of |components|, mean and sd of the component."""
    whole = add([F.abs(c) for c in components])
    return long_agg(df, components, {"importance": lambda c: F.avg(safe_div(F.abs(c), whole)), "mean": F.avg,
                                     "sd": F.stddev_samp}, label="component")


def mediation_by_corr(df: DataFrame, x: str, m: str, y: str) -> DataFrame:
    r = df.agg(F.corr(x, y).alias("direct"), F.corr(x, m).alias("r_xm"), F.corr(m, y).alias("r_my"))
    return r.withColumn("indirect", F.col("r_xm") * F.col("r_my")).withColumn("total", F.col("direct") + F.col("indirect"))


def error_scale(df: DataFrame, chosen: str) -> DataFrame:
    """Error scale implied by the choice variance, per error law."""
    m = df.agg(F.var_samp(chosen).alias("v"))
    return m.select(F.sqrt(F.col("v") * 6 / math.pi ** 2).alias("gumbel"), F.sqrt("v").alias("normal"),
                    F.sqrt(F.col("v") * 3 / math.pi ** 2).alias("logistic"))


# ---- covariance matrices ---------------------------------------------------------------------------------

def cov_sufficient_stats(df: DataFrame, columns: list[str], keys: list[str] = (), weight: str | None = None) -> DataFrame:
    """Listwise n, means and (n-1) covariances in long form (var1, var2, cov, mean1, mean2, n), upper triangle
    with the diagonal. With ``weight`` the rows count as frequency weights."""
    keys = list(keys)
    full = df.dropna(subset=columns)
    pairs = list(combinations(columns, 2)) + [(c, c) for c in columns]
    if weight is None:
        wide = full.groupBy(*keys).agg(F.count(ONE).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns],
                                       *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
        cov = [F.col(f"c{i}") for i in range(len(pairs))]
        mean = {c: F.col(f"m_{c}") for c in columns}
        n = F.col("n")
    else:
        w = F.col(weight).cast("double")
        wide = full.groupBy(*keys).agg(F.sum(w).alias("n"), *[F.sum(w * F.col(c)).alias(f"s_{c}") for c in columns],
                                       *[F.sum(w * F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
        n = F.col("n")
        mean = {c: F.col(f"s_{c}") / n for c in columns}
        cov = [(F.col(f"p{i}") - F.col(f"s_{a}") * F.col(f"s_{b}") / n) / (n - 1) for i, (a, b) in enumerate(pairs)]
    return inline(wide, keys, [{"var1": F.lit(a), "var2": F.lit(b), "cov": cov[i], "mean1": mean[a], "mean2": mean[b],
                                "n": n.cast("bigint")} for i, (a, b) in enumerate(pairs)])
