"""Descriptive, correlation, reliability, validity and effect queries on the driver tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import encode, models, stats
from .bindings import (COMPLETE, FACTORS, ITEM_COLS, ITEMS, LOADINGS, LONG, OPT, PATHS, SCORES, choice_long, choice_rows,
                       complete_scores, items, paths, scores, with_opt_out)
from .registry import query

NA = "cast(label = 'A' as integer)"
HI = "cast(disc > 0.05 as integer)"
# long rows with two 0/1 attributes, a score and a linear utility
RICH = LONG + ", " + SCORES + f""", rich as (select long.id, sid, alt, chosen, price, disc, tax, label, {NA} as a, {HI} as h, sa, sb,
    0.8 * {NA} as u_sugar, 0.5 * {HI} as u_label, -0.00001 * price as u_price,
    0.8::DOUBLE * {NA} + 0.5::DOUBLE * {HI} - 0.00001::DOUBLE * price as u, segment
  from long left join scores on long.id = scores.id)""".replace("0.8 *", "0.8::DOUBLE *").replace("0.5 *", "0.5::DOUBLE *").replace("-0.00001 *", "-0.00001::DOUBLE *")


def rich(t):
    df = choice_rows(t).join(scores(t).select("id", "sa", "sb", "segment"), "id", "left").withColumns(
        {"a": (F.col("label") == "A").cast("int"), "h": (F.col("disc") > 0.05).cast("int")})
    df = df.withColumns({"u_sugar": 0.8 * F.col("a"), "u_label": 0.5 * F.col("h"), "u_price": -0.00001 * F.col("price")})
    return df.withColumn("u", F.col("u_sugar") + F.col("u_label") + F.col("u_price"))


# ---- shares and simple tables ----------------------------------------------------------------------------


@query("choice_share", doubles="share", sql=f"""with {LONG} select alt, cast(sum(chosen) as bigint) as n_chosen, sum(chosen) / (select sum(chosen) from long)::DOUBLE as share
  from long group by alt""")
def _(t):
    return stats.choice_share(choice_long(t), "alt", "chosen")


@query("chosen_by_level", sql=f"with {LONG} select label, cast(count(*) as bigint) as n_chosen from long where chosen = 1 and label <> 'R' group by label")
def _(t):
    return stats.chosen_by_level(choice_rows(t), "label", "chosen", F.col("label") == "R")


@query("choice_rate_by_level", doubles="rate", sql=f"with {LONG} select disc as level, cast(count(*) as bigint) as n_shown, avg(chosen) as rate from long group by disc")
def _(t):
    return stats.choice_rate_by_level(choice_rows(t).withColumnRenamed("disc", "level"), "level", "chosen")


@query("chi2_independence", doubles="chi2:5 p_value", sql=f"""with {LONG}, c as (select label, chosen, count(*)::DOUBLE as n from long group by all),
  e as (select n, sum(n) over (partition by label) * sum(n) over (partition by chosen) / sum(n) over () as e, sum(n) over () as total from c),
  s as (select cast(max(total) as bigint) as n, sum((n - e) * (n - e) / e) as chi2 from e)
  select n, chi2, cast(2 as bigint) as dof, exp(-chi2 / 2) as p_value from s""")
def _(t):
    return stats.chi2_independence(choice_rows(t), "label", "chosen")


@query("describe_columns", doubles="mean sd min max", sql=f"with {OPT} " + " union all ".join(
    f"select '{c}' as column_name, count({c}) as n, avg({c}) as mean, stddev_samp({c}) as sd, cast(min({c}) as double) as min, cast(max({c}) as double) as max, count(distinct {c}) as n_distinct from opt"
    for c in ("price", "disc", "tax", "chosen")))
def _(t):
    return stats.describe_columns(with_opt_out(choice_rows(t)), ["price", "disc", "tax", "chosen"])


@query("choice_data_summary", doubles="a_rate h_rate price_mean price_sd price_min price_max", sql=f"""with {RICH}
  select count(distinct id) as n_ids, count(*) as n_rows, cast(sum(chosen) as bigint) as n_chosen, avg(a) as a_rate, avg(h) as h_rate,
    avg(price) as price_mean, stddev_samp(price) as price_sd, min(price) as price_min, max(price) as price_max from rich""")
def _(t):
    return stats.choice_data_summary(rich(t), "id", "chosen", ["a", "h"], "price")


@query("design_balance", sql="""select 'p_type' as attribute, p_type as level, cast(count(*) as bigint) as n from part group by all
  union all select 'p_size', p_size::VARCHAR, cast(count(*) as bigint) from part group by all
  union all select 'p_type x p_size', p_type || ' x ' || p_size, cast(count(*) as bigint) from part group by all""")
def _(t):
    return stats.design_balance(t.part, ["p_type", "p_size"])



_SKEW = "avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5)"
_KURT = "avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3"


@query("distribution_profile", doubles="mean sd min max skewness kurtosis p01 p05 p10 p25 p50 p75 p90 p95 p99", sql="""with b as (select l_extendedprice as x, avg(l_extendedprice) over () as m from lineitem)
  select count(*) as n, avg(x) as mean, stddev_samp(x) as sd, min(x) as min, max(x) as max, """ + _SKEW + " as skewness, " + _KURT + " as kurtosis, " + ", ".join(
    f"quantile_cont(x, {p}) as p{round(p * 100):02d}" for p in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)) + " from b")
def _(t):
    return stats.distribution_profile(t.lineitem, "l_extendedprice")


@query("normality_test", doubles="skewness kurtosis jb:4 p_value", sql=f"""with b as (select value as x, avg(value) over () as m from events),
  s as (select count(*) as n, {_SKEW} as skewness, {_KURT} as kurtosis from b)
  select n, skewness, kurtosis, n / 6 * (skewness * skewness + kurtosis * kurtosis / 4) as jb, exp(-n / 6 * (skewness * skewness + kurtosis * kurtosis / 4) / 2) as p_value,
    exp(-n / 6 * (skewness * skewness + kurtosis * kurtosis / 4) / 2) > 0.05 as is_normal from s""")
def _(t):
    return stats.normality_test(t.events, "value")


@query("quantiles", doubles="q0025 q0500 q0975", sql="""select event_type, quantile_cont(value, 0.025) as q0025, quantile_cont(value, 0.5) as q0500, quantile_cont(value, 0.975) as q0975
  from events group by event_type""")
def _(t):
    return stats.quantiles(t.events, ["event_type"], "value", [0.025, 0.5, 0.975])


# ---- correlations ----------------------------------------------------------------------------------------


def _corr_sql(table, pairs):
    return " union all ".join(f"select '{a}' as var1, '{b}' as var2, corr({a}, {b}) as r, cast(count(*) filter (where {a} is not null and {b} is not null) as bigint) as n from {table}" for a, b in pairs)


@query("corr_matrix_items", doubles="r", sql=f"with {ITEMS}, long_items as (select items.* from items join orders on o_custkey = items.id), grain as (select distinct * from long_items) "
       + _corr_sql("grain", combinations(ITEM_COLS, 2)))
def _(t):
    rows = items(t).join(t.orders.select(F.col("o_custkey").alias("id"), "o_orderkey"), "id")
    return stats.corr_matrix(rows, ITEM_COLS, "id", ["o_orderkey"])


@query("corr_matrix_attrs", doubles="r", sql=f"with {OPT} " + _corr_sql("opt", combinations(["price", "disc", "tax"], 2)))
def _(t):
    return stats.corr_matrix(with_opt_out(choice_rows(t)), ["price", "disc", "tax"])


_COV = ITEMS + """, spent as (select o_custkey as id, o_orderkey, o_totalprice as total from orders),
  covars as (select spent.id, balance, nation, total from spent join items on spent.id = items.id qualify row_number() over (partition by spent.id order by o_orderkey) = 1)"""


@query("corr_matrix_covars", doubles="r", sql=f"with {_COV} " + _corr_sql("covars", combinations(["balance", "nation", "total"], 2)))
def _(t):
    rows = items(t).join(t.orders.selectExpr("o_custkey as id", "o_orderkey", "o_totalprice as total"), "id")
    return stats.corr_matrix(rows, ["balance", "nation", "total"], "id", ["o_orderkey"])


_FIRST = LONG + ", " + SCORES + """, firsts as (select long.id, price, disc, tax, sa, sb, balance from long join scores on long.id = scores.id join items on long.id = items.id
  qualify row_number() over (partition by long.id order by sid, alt) = 1)"""


def _first_rows(t):
    return choice_long(t).join(scores(t).select("id", "sa", "sb"), "id").join(items(t).select("id", "balance"), "id")


@query("corr_lv_attr", doubles="r", sql=f"with {_FIRST} " + _corr_sql("firsts", [(a, b) for a in ("sa", "sb") for b in ("price", "disc", "tax")]))
def _(t):
    return stats.corr_block(_first_rows(t), ["sa", "sb"], ["price", "disc", "tax"], "id", ["sid", "alt"])


@query("corr_lv_covar", doubles="r", sql=f"with {SCORES}, j as (select scores.*, balance from scores join items on scores.id = items.id) " + _corr_sql("j", [(a, b) for a in ("sa", "sb") for b in ("balance", "nation")]))
def _(t):
    return stats.corr_block(scores(t).join(items(t).select("id", "balance"), "id"), ["sa", "sb"], ["balance", "nation"])


_FULL = ["sa", "sb", "price", "disc", "tax", "balance"]


@query("corr_full", doubles="r", sql=f"with {_FIRST} " + _corr_sql("firsts", combinations(_FULL, 2)))
def _(t):
    return stats.corr_matrix(_first_rows(t), _FULL, "id", ["sid", "alt"])


@query("corr_significance", doubles="r t:5", sql=f"with {ITEMS}, c as ({_corr_sql('items', combinations(ITEM_COLS, 2))}) select var1, var2, r, n, r * sqrt((n - 2) / (1 - r * r)) as t from c")
def _(t):
    return stats.corr_significance(stats.corr_matrix(items(t), ITEM_COLS)).drop("p_value")


@query("corr_summary", doubles="max_abs_r", sql=f"""with {ITEMS}, c as ({_corr_sql('items', combinations(ITEM_COLS, 2))})
  select count(*) as n_pairs, cast(count(*) filter (where abs(r) > 0.5) as bigint) as n_strong, cast(count(*) filter (where abs(r) > 0.3 and abs(r) <= 0.5) as bigint) as n_moderate,
    cast(count(*) filter (where abs(r) <= 0.3) as bigint) as n_weak, max(abs(r)) as max_abs_r, arg_max(var1 || '~' || var2, abs(r)) as strongest from c""")
def _(t):
    return stats.corr_summary(stats.corr_matrix(items(t), ITEM_COLS))


@query("factor_corr_simple", doubles="r", sql=f"with {SCORES} " + _corr_sql("scores", combinations(["sa", "sb", "sc"], 2)))
def _(t):
    return stats.corr_matrix(scores(t), ["sa", "sb", "sc"])


# ---- scores ----------------------------------------------------------------------------------------------


@query("score_variance_check", doubles="mean variance sd min max", sql=f"with {SCORES} " + " union all ".join(
    f"select '{s}' as factor, avg({s}) as mean, var_pop({s}) as variance, stddev_pop({s}) as sd, min({s}) as min, max({s}) as max, var_pop({s}) < 0.01 as too_small from scores" for s in ("sa", "sb", "sc")))
def _(t):
    return stats.score_variance_check(scores(t), ["sa", "sb", "sc"])


@query("score_summary", doubles="mean sd min max q25 q50 q75", sql=f"""with {SCORES} select count(sc) as n, avg(sc) as mean, stddev_samp(sc) as sd, min(sc) as min, max(sc) as max,
  quantile_cont(sc, 0.25) as q25, quantile_cont(sc, 0.5) as q50, quantile_cont(sc, 0.75) as q75 from scores""")
def _(t):
    return stats.score_summary(scores(t), "sc")


_LEVEL = "case when sa / 5 < 0 then null when sa / 5 <= 0.33 then 'Low' when sa / 5 <= 0.67 then 'Medium' when sa / 5 <= 1 then 'High' end"


@query("factor_effects_summary", doubles="value", sql=f"""with {RICH} select 'mean' as statistic, '' as level, avg(sa) as value from rich
  union all select 'sd', '', stddev_samp(sa) from rich union all select 'r_choice', '', corr(sa, chosen) from rich
  union all select 'mean_by_a', a::VARCHAR, avg(sa) from rich group by a union all select 'mean_by_h', h::VARCHAR, avg(sa) from rich group by h
  union all select 'choice_rate', {_LEVEL}, avg(chosen) from rich where sa is not null group by {_LEVEL}""")
def _(t):
    df = rich(t).withColumn("s", F.col("sa") / 5)
    return stats.factor_effects_summary(df.withColumn("lv", encode.bin_fixed("s")), "sa", "chosen", ["a", "h"], "lv")


# ---- reliability and validity ----------------------------------------------------------------------------


def _alpha_sql(f, cols):
    total, k = " + ".join(cols), len(cols)
    return (f"select '{f}' as factor, {k} as n_items, count(*) as n, {k}::DOUBLE / {k - 1} * (1 - ({' + '.join(f'var_samp({c})' for c in cols)}) / var_samp({total})) as alpha "
            f"from raw2 where {total} is not null")


_RAW2 = ITEMS + ", raw2 as (select id, " + ", ".join(f"case when id % 17 <> {k} then {q} end as {q}" for k, q in enumerate(ITEM_COLS, 1)) + " from items)"


def _with_gaps(t):
    return items(t).select("id", *[F.when(F.col("id") % 17 != k, F.col(q)).alias(q) for k, q in enumerate(ITEM_COLS, 1)])


@query("cronbach_alpha", doubles="alpha", sql=f"with {_RAW2} " + " union all ".join(_alpha_sql(f, c) for f, c in FACTORS.items()))
def _(t):
    return stats.cronbach_alpha(_with_gaps(t), FACTORS)


_CR = "sum(loading) * sum(loading) / (sum(loading) * sum(loading) + sum(1 - loading * loading))"
_AVE = "sum(loading * loading) / (sum(loading * loading) + sum(1 - loading * loading))"


@query("composite_reliability", doubles="cr", sql=f"with {LOADINGS} select factor, {_CR} as cr from loadings group by factor")
def _(t):
    return stats.composite_reliability(stats.item_total_loadings(items(t), FACTORS))


@query("ave", doubles="ave sqrt_ave", sql=f"with {LOADINGS} select factor, {_AVE} as ave, sqrt({_AVE}) as sqrt_ave from loadings group by factor")
def _(t):
    return stats.ave(stats.item_total_loadings(items(t), FACTORS))


@query("reliability_table", doubles="alpha cr ave sqrt_ave mean_loading min_loading max_loading", sql=f"""with {LOADINGS}, raw2 as (select * from items), al as ({' union all '.join(_alpha_sql(f, c) for f, c in FACTORS.items())}),
  l as (select factor, {_CR} as cr, {_AVE} as ave, sqrt({_AVE}) as sqrt_ave, avg(loading) as mean_loading, min(loading) as min_loading, max(loading) as max_loading from loadings group by factor)
  select al.*, cr, ave, sqrt_ave, mean_loading, min_loading, max_loading, alpha >= 0.7 as alpha_ok, cr >= 0.7 as cr_ok, ave >= 0.5 as ave_ok from al join l on al.factor = l.factor""")
def _(t):
    it = items(t)
    return stats.reliability_table(it, FACTORS, stats.item_total_loadings(it, FACTORS))


# three factors per segment of customers: loadings by item, correlations of the factor means
_FL = LOADINGS.replace("spend as", "spend as") + f""", fac as (select (q1 + q2 + q3 + q4) / 4.0::DOUBLE as "A", (q5 + q6 + q7) / 3.0::DOUBLE as "B" from items),
  av as (select factor, sqrt({_AVE}) as s from loadings group by factor),
  fl as (select 'A' as var1, 'B' as var2, abs(corr("A", "B")) as abs_r, (select s from av where factor = 'A') as sqrt_ave_1, (select s from av where factor = 'B') as sqrt_ave_2 from fac),
  flv as (select *, least(sqrt_ave_1, sqrt_ave_2) as min_sqrt_ave, abs_r < least(sqrt_ave_1, sqrt_ave_2) as valid, least(sqrt_ave_1, sqrt_ave_2) - abs_r as margin from fl)"""


def _factor_means(t):
    return items(t).select(*[encode.factor_score_mean(c).alias(f) for f, c in FACTORS.items()])


def _fl(t):
    return stats.fornell_larcker(stats.corr_matrix(_factor_means(t), list(FACTORS)), stats.ave(stats.item_total_loadings(items(t), FACTORS)))


@query("fornell_larcker", doubles="abs_r sqrt_ave_1 sqrt_ave_2 min_sqrt_ave margin", sql=f"with {_FL} select * from flv")
def _(t):
    return _fl(t)


@query("validity_summary", doubles="rate", sql=f"""with {_FL} select count(*) as n_pairs, cast(count(*) filter (where valid) as bigint) as n_valid, cast(count(*) filter (where not valid) as bigint) as n_invalid,
  count(*) filter (where valid) / count(*)::DOUBLE as rate, bool_and(valid) as overall from flv""")
def _(t):
    return stats.validity_summary(_fl(t))


@query("validity_matrix", doubles="A B", sql=f"""with {_FL} select 'A' as factor, (select s from av where factor = 'A') as "A", corr("A", "B") as "B" from fac
  union all select 'B', corr("A", "B"), (select s from av where factor = 'B') from fac""")
def _(t):
    return stats.validity_matrix(stats.corr_matrix(_factor_means(t), list(FACTORS)), stats.ave(stats.item_total_loadings(items(t), FACTORS)), list(FACTORS))


_FOF = {q: f for f, c in FACTORS.items() for q in c}


@query("htmt", doubles="htmt", sql=f"with {ITEMS}, c as (" + " union all ".join(
    f"select '{_FOF[a]}' as f1, '{_FOF[b]}' as f2, abs(corr({a}, {b})) as r from items" for a, b in combinations(ITEM_COLS, 2)) + """),
  m as (select f1, f2, avg(r) as m from c group by all), h as (select x.f1, x.f2, x.m / sqrt(p.m * q.m) as htmt from m x join m p on p.f1 = x.f1 and p.f2 = x.f1 join m q on q.f1 = x.f2 and q.f2 = x.f2 where x.f1 <> x.f2)
  select f1, f2, htmt, htmt < 0.85 as valid from h""")
def _(t):
    return stats.htmt(items(t), FACTORS)


# ---- effects ---------------------------------------------------------------------------------------------


@query("mean_diff_by_choice", doubles="mean_chosen mean_not_chosen difference", sql=f"with {LONG} " + " union all ".join(
    f"select '{c}' as variable, avg({c}) filter (where chosen = 1) as mean_chosen, avg({c}) filter (where chosen = 0) as mean_not_chosen, avg({c}) filter (where chosen = 1) - avg({c}) filter (where chosen = 0) as difference from long"
    for c in ("price", "disc", "tax")))
def _(t):
    return stats.mean_diff_by_choice(choice_rows(t), ["price", "disc", "tax"], "chosen")


@query("scale_profile", doubles="mean sd min max", sql=f"with {RICH}, p as (select price, sa, sa * disc as sa_disc, (price - avg(price) over ()) / stddev_samp(price) over () as price_z from rich) " + " union all ".join(
    f"select '{c}' as variable, avg({c}) as mean, stddev_samp({c}) as sd, min({c}) as min, max({c}) as max, abs(avg({c})) < 0.1 and abs(stddev_samp({c}) - 1) < 0.1 as standardised from p"
    for c in ("price", "sa", "sa_disc", "price_z")))
def _(t):
    df = encode.zscore_sample(rich(t).withColumn("sa_disc", F.col("sa") * F.col("disc")), ["price"])
    return stats.scale_profile(df, ["price", "sa", "sa_disc", "price_z"])


@query("attr_effect_binary", doubles="mean0 sd0 mean1 sd1 difference pooled_sd cohens_d t", sql=f"""with {RICH}, m as (select count(*) filter (where a = 0) as n0, avg(u) filter (where a = 0) as mean0, stddev_samp(u) filter (where a = 0) as sd0,
    count(*) filter (where a = 1) as n1, avg(u) filter (where a = 1) as mean1, stddev_samp(u) filter (where a = 1) as sd1 from rich),
  p as (select *, mean1 - mean0 as difference, sqrt(((n0 - 1) * sd0 * sd0 + (n1 - 1) * sd1 * sd1) / (n0 + n1 - 2)) as pooled_sd from m)
  select *, difference / pooled_sd as cohens_d, difference / (pooled_sd * sqrt(1 / n0::DOUBLE + 1 / n1::DOUBLE)) as t from p""")
def _(t):
    return stats.attr_effect_binary(rich(t), "a", "u").drop("p_value")


@query("attr_effect_continuous", doubles="r slope:9 intercept r2", sql=f"""with {RICH} select corr(disc, u) as r, regr_slope(u, disc) as slope, regr_intercept(u, disc) as intercept, regr_r2(u, disc) as r2, count(*) as n from rich""")
def _(t):
    return stats.attr_effect_continuous(rich(t), "disc", "u")


@query("quartile_effects", doubles="mean sd", sql=f"""with {RICH}, q as (select quantile_cont(price, 0.25) as a1, quantile_cont(price, 0.5) as a2, quantile_cont(price, 0.75) as a3 from rich)
  select case when price <= a1 then 'Q1' when price <= a2 then 'Q2' when price <= a3 then 'Q3' else 'Q4' end as quartile, count(*) as n, avg(u) as mean, stddev_samp(u) as sd from rich, q group by 1""")
def _(t):
    return stats.quartile_effects(rich(t), "price", "u")


@query("preference_stats", doubles="attribute_rate choice_rate_with choice_rate_without", sql=f"""with {RICH} select avg(a) as attribute_rate, avg(chosen) filter (where a = 1) as choice_rate_with,
  avg(chosen) filter (where a = 0) as choice_rate_without from rich""")
def _(t):
    return stats.preference_stats(rich(t), "a", "chosen")


@query("price_sensitivity_stats", doubles="mean sd min max mean_chosen mean_not_chosen r_choice", sql=f"""with {LONG} select avg(price) as mean, stddev_samp(price) as sd, min(price) as min, max(price) as max,
  avg(price) filter (where chosen = 1) as mean_chosen, avg(price) filter (where chosen = 0) as mean_not_chosen, corr(price, chosen) as r_choice from long""")
def _(t):
    return stats.price_sensitivity_stats(choice_rows(t), "price", "chosen")


@query("interaction_stats", doubles="mean sd non_zero_rate r_choice both_on first_only second_only neither", sql=f"""with {RICH} select avg(a * h) as mean, stddev_samp(a * h) as sd, min(a * h) as min, max(a * h) as max,
  avg(case when a * h <> 0 then 1.0::DOUBLE else 0 end) as non_zero_rate, corr(a * h, chosen) as r_choice, avg(chosen) filter (where a = 1 and h = 1) as both_on, avg(chosen) filter (where a = 1 and h = 0) as first_only,
  avg(chosen) filter (where a = 0 and h = 1) as second_only, avg(chosen) filter (where a = 0 and h = 0) as neither from rich""")
def _(t):
    return stats.interaction_stats(rich(t), "a", "h", "chosen")


@query("choice_rate_by_tertile", doubles="choice_rate a_preference h_preference", sql=f"""with {RICH}, q as (select quantile_cont(sa, 0.33) as lo, quantile_cont(sa, 0.67) as hi from rich)
  select case when sa <= lo then 'Low' when sa <= hi then 'Medium' else 'High' end as tertile, count(*) as n, avg(chosen) as choice_rate, avg(a) as a_preference, avg(h) as h_preference from rich, q group by 1""")
def _(t):
    return stats.choice_rate_by_tertile(rich(t), "sa", "chosen", ["a", "h"])


@query("elasticity_by_segment", doubles="r", sql=f"with {RICH} select segment, count(*) as n, corr(price, chosen) as r from rich group by segment having count(*) > 10")
def _(t):
    return stats.elasticity_by_segment(rich(t), "segment", "price", "chosen")


# ---- predictions and components ----------------------------------------------------------------------------


@query("confusion_matrix", doubles="accuracy precision recall f1", sql=f"""with {RICH}, p as (select chosen, 1 / (1 + exp(-u)) as p from rich),
  m as (select cast(count(*) filter (where p >= 0.5 and chosen = 1) as bigint) as tp, cast(count(*) filter (where p >= 0.5 and chosen = 0) as bigint) as fp,
    cast(count(*) filter (where p < 0.5 and chosen = 1) as bigint) as fn, cast(count(*) filter (where p < 0.5 and chosen = 0) as bigint) as tn from p)
  select *, (tp + tn) / (tp + tn + fp + fn)::DOUBLE as accuracy, tp / (tp + fp)::DOUBLE as precision, tp / (tp + fn)::DOUBLE as recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE as f1 from m""")
def _(t):
    return stats.confusion_matrix(rich(t).withColumn("p", 1 / (1 + F.exp(-F.col("u")))), "chosen", "p")


@query("auc", doubles="auc", sql=f"""with {LONG}, r as (select chosen, rank() over (order by price) + (count(*) over (partition by price) - 1) / 2.0::DOUBLE as rk from long),
  s as (select cast(count(*) filter (where chosen = 1) as bigint) as n_pos, cast(count(*) filter (where chosen = 0) as bigint) as n_neg, sum(rk) filter (where chosen = 1) as w from r)
  select n_pos, n_neg, (w - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg) as auc from s""")
def _(t):
    return stats.auc(choice_rows(t).select("chosen", "price"), "chosen", "price")


@query("auc_embeddings", doubles="auc", sql="""with j as (select quality, embedding[1]::DOUBLE as score from embeddings join labels on vec_id = doc_id),
  r as (select quality, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::DOUBLE as rk from j),
  s as (select cast(count(*) filter (where quality = 1) as bigint) as n_pos, cast(count(*) filter (where quality = 0) as bigint) as n_neg, sum(rk) filter (where quality = 1) as w from r)
  select n_pos, n_neg, (w - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg) as auc from s""")
def _(t):
    j = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding")[0].cast("double").alias("score")).join(t.labels, "doc_id")
    return stats.auc(j, "quality", "score")


_PARTS = ["u_sugar", "u_label", "u_price"]


@query("component_stats", doubles="mean sd min max range cv variance_share", sql=f"with {RICH} " + " union all ".join(
    f"select '{c}' as component, avg({c}) as mean, stddev_samp({c}) as sd, cast(min({c}) as double) as min, cast(max({c}) as double) as max, cast(max({c}) - min({c}) as double) as range, stddev_samp({c}) / abs(avg({c})) as cv, var_samp({c}) / (select var_samp(u) from rich) as variance_share from rich"
    for c in _PARTS))
def _(t):
    return stats.component_stats(rich(t), _PARTS, "u")


@query("component_importance", doubles="importance mean sd", sql=f"with {RICH} " + " union all ".join(
    f"select '{c}' as component, avg(abs({c}) / (abs(u_sugar) + abs(u_label) + abs(u_price))) as importance, avg({c}) as mean, stddev_samp({c}) as sd from rich" for c in _PARTS))
def _(t):
    return stats.component_importance(rich(t), _PARTS)


@query("mediation_by_corr", doubles="direct r_xm r_my indirect total", sql=f"""with {COMPLETE}, r as (select corr(sa, sc) as direct, corr(sa, sb) as r_xm, corr(sb, sc) as r_my from complete)
  select *, r_xm * r_my as indirect, direct + r_xm * r_my as total from r""")
def _(t):
    return stats.mediation_by_corr(complete_scores(t), "sa", "sb", "sc")


@query("error_scale", doubles="gumbel normal logistic", sql=f"with {LONG}, v as (select var_samp(chosen) as v from long) select sqrt(v * 6) / pi() as gumbel, sqrt(v) as normal, sqrt(v * 3) / pi() as logistic from v")
def _(t):
    return stats.error_scale(choice_rows(t), "chosen")


_CV = ["q1", "q2", "q5"]


@query("cov_sufficient_stats", doubles="cov mean1 mean2", sql=f"with {_RAW2}, f as (select * from raw2 where q1 is not null and q2 is not null and q5 is not null) " + " union all ".join(
    f"select '{a}' as var1, '{b}' as var2, covar_samp({a}, {b}) as cov, avg({a}) as mean1, avg({b}) as mean2, count(*) as n from f" for a, b in list(combinations(_CV, 2)) + [(c, c) for c in _CV]))
def _(t):
    return stats.cov_sufficient_stats(_with_gaps(t), _CV)


@query("factor_effect_lookup", doubles="estimate", sql=f"""with {PATHS}, w as (select * from (values ('sa', 'sb', 'benefit_effect'), ('sb', 'sc', 'knowledge_effect'), ('sc', 'sd', 'price_effect')) v(f, g, alias))
  select model, alias, estimate from paths join w on rval = f and lval = g""")
def _(t):
    wanted = t.spark.createDataFrame([("sa", "sb", "benefit_effect"), ("sb", "sc", "knowledge_effect"), ("sc", "sd", "price_effect")],
                                     "from_var string, to_var string, alias string")
    return models.factor_effect_lookup(paths(t), wanted, ["model"])
