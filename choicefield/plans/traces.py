"""Iteration traces and model tables on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import two_sided_p
from ..operators import iterations as it
from ..operators import models
from ..operators.shape import modification_filter
from ..sources.runs import significant_params
from .bindings import LONG, PATHS, RESULTS, RUNS, TRACE, choice_long, choice_rows, paths, results, runs, sql_norm_cdf, trace
from .registry import query


@query("alt_index", sql=f"with {LONG} select sid, alt, alt - 1 as alt_index from long")
def _(t):
    return it.alt_index(choice_long(t).select("sid", "alt"), ["sid"], ["alt"])


@query("set_id", sql="select o_custkey, o_orderkey, cast(dense_rank() over (order by o_custkey, o_orderkey) as bigint) as set_index from orders join lineitem on l_orderkey = o_orderkey")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey")
    return it.set_id(rows, ["o_custkey", "o_orderkey"])


@query("iteration_deltas", doubles="ll:2 prev_ll:2 change:4 change_pct", sql=f"""with {TRACE}, d as (select run, iteration, ll, lag(ll) over (partition by run order by ts, iteration) as prev_ll from trace)
  select *, ll - prev_ll as change, 100 * (ll - prev_ll) / nullif(abs(prev_ll), 0) as change_pct, ll - prev_ll > 0 as improved from d""")
def _(t):
    return it.iteration_deltas(trace(t).select("run", "ts", "iteration", "ll"), "run", ["ts", "iteration"], "ll").drop("ts")


_TIMED = TRACE + """, timed as (select run, iteration, epoch_us(ts) / 1e6::DOUBLE - lag(epoch_us(ts)) over (partition by run order by ts, iteration) / 1e6::DOUBLE as seconds,
  epoch_us(ts) / 1e6::DOUBLE - min(epoch_us(ts)) over (partition by run) / 1e6::DOUBLE as elapsed from trace)"""


@query("iteration_timing", doubles="seconds:4 elapsed:4", sql=f"with {_TIMED} select run, iteration, seconds, elapsed from timed")
def _(t):
    return it.iteration_timing(trace(t), "run", ["ts", "iteration"], "ts").select("run", "iteration", "seconds", "elapsed")


@query("timing_summary", doubles="mean_seconds:4 max_seconds:4 min_seconds:4 total_seconds:4", sql=f"""with {_TIMED} select run, count(*) as n_iterations, avg(seconds) as mean_seconds,
  max(seconds) as max_seconds, min(seconds) as min_seconds, max(elapsed) as total_seconds from timed group by run""")
def _(t):
    return it.timing_summary(it.iteration_timing(trace(t), "run", ["ts", "iteration"], "ts"), "run")


@query("tail_stats", doubles="ll_sd", sql=f"""with {TRACE}, l as (select * from trace qualify row_number() over (partition by run order by iteration desc) <= 10)
  select run, count(*) as n, stddev_samp(ll) as ll_sd from l group by run""")
def _(t):
    return it.tail_stats(trace(t), "run", ["-iteration"], ["ll"])


# parameter trace: one parameter per event type, constant gradient for clicks
_PTRACE = """ptrace as (select user_id as run, event_type as parameter, event_id as iteration, value, case when event_type = 'click' then 0.25::DOUBLE else value / 100 end as gradient from events)"""


def ptrace(t):
    return t.events.selectExpr("user_id as run", "event_type as parameter", "event_id as iteration", "value",
                               "case when event_type = 'click' then 0.25D else value / 100 end as gradient")


@query("frozen_params", doubles="gradient_sd value_sd first_value last_value percent_change:9", sql=f"""with {_PTRACE}, g as (select run, parameter, count(*) as n, stddev_pop(gradient) as gradient_sd, stddev_pop(value) as value_sd,
    arg_min(value, iteration) as first_value, arg_max(value, iteration) as last_value from ptrace group by run, parameter)
  select *, gradient_sd < 1e-10 as gradient_frozen, gradient_sd < 1e-6 as gradient_nearly_frozen, value_sd < 1e-10 as value_frozen,
    100 * (last_value - first_value) / nullif(abs(first_value), 0) as percent_change from g""")
def _(t):
    return it.frozen_params(ptrace(t), ["run", "parameter"], "iteration", "value", "gradient")


@query("convergence_status", sql="""with b as (select user_id as run, case event_type when 'error' then 'FAIL' when 'click' then 'WARN' else 'OK' end as status,
    case when event_type <> 'view' then value / 10000 end as ftol, value / 20000 as gtol from events)
  select run, count(*) as n, cast(count(*) filter (where status = 'OK') as bigint) as n_ok, cast(count(*) filter (where status = 'WARN') as bigint) as n_warn, cast(count(*) filter (where status = 'FAIL') as bigint) as n_fail,
    cast(count(*) filter (where ftol <= 0.001::DOUBLE) as bigint) as n_ftol, count(ftol) as n_with_ftol, cast(count(*) filter (where gtol <= 0.001::DOUBLE) as bigint) as n_gtol from b group by run""")
def _(t):
    df = t.events.selectExpr("user_id as run", "case event_type when 'error' then 'FAIL' when 'click' then 'WARN' else 'OK' end as status",
                             "case when event_type <> 'view' then value / 10000 end as ftol", "value / 20000 as gtol")
    return it.convergence_status(df, ["run"], "status", "ftol", "gtol")


@query("early_stop_point", doubles="best_ll:2", sql=f"""with {TRACE}, s as (select run, ll, row_number() over (partition by run order by ts, iteration) as step from trace),
  b as (select *, max(ll) over (partition by run order by step) as best, max(ll) over (partition by run order by step rows between unbounded preceding and 1 preceding) as prev from s),
  g as (select *, max(case when prev is null or ll > prev + 0.000001 then step end) over (partition by run order by step) as last_gain from b),
  f as (select run, min(step) as stop_step, arg_min(best, step) as best_ll from g where step - last_gain >= 5 group by run),
  n as (select run, count(*) as n_evaluations from trace group by run)
  select n.run, n_evaluations, stop_step, best_ll, stop_step is not null as stopped from n left join f on n.run = f.run""")
def _(t):
    return it.early_stop_point(trace(t), "run", ["ts", "iteration"], "ll")


@query("convergence_forecast", doubles="last linear decay average confidence", sql=f"""with {_PTRACE}, l as (select run, parameter, value, row_number() over (partition by run, parameter order by iteration desc) as k from ptrace),
  v as (select run, parameter, max(value) filter (where k = 1) as v1, max(value) filter (where k = 2) as v2, max(value) filter (where k = 3) as v3 from l where k <= 3 group by all),
  d as (select *, v1 - v2 as d1, v2 - v3 as d2, coalesce((v1 - v3) / 2, v1 - v2) as c from v),
  r as (select *, case when d2 is null or abs(d2) <= 1e-6 then 0.9::DOUBLE else least(greatest(d1 / d2, 0), 1) end as r from d)
  select run, parameter, v1 as last, v1 + c * 10 as linear, case when abs(c) < 1e-6 then v1 else v1 + c * case when abs(1 - r) > 1e-6 then (1 - power(r, 50)) / (1 - r) else 50 end end as decay,
    (v1 + v2) / 2 as average, 1 / (1 + abs(c) * 10) as confidence from r""")
def _(t):
    return it.convergence_forecast(ptrace(t), ["run", "parameter"], ["-iteration"], "value")


@query("gradient_stats_by_group", doubles="mean_abs max_abs min_abs view_over_error purchase_over_error", sql=f"""with {_PTRACE}, s as (select run, parameter, count(*) as n, avg(abs(gradient)) as mean_abs, max(abs(gradient)) as max_abs, min(abs(gradient)) as min_abs from ptrace group by all),
  b as (select run, avg(abs(gradient)) filter (where parameter = 'error') as e, avg(abs(gradient)) filter (where parameter = 'view') as v, avg(abs(gradient)) filter (where parameter = 'purchase') as p from ptrace group by run)
  select s.*, v / e as view_over_error, p / e as purchase_over_error from s join b on s.run = b.run""")
def _(t):
    return it.gradient_stats_by_group(ptrace(t), ["run"], "parameter", "gradient", "error", ["view", "purchase"])


# ---- model tables ----------------------------------------------------------------------------------------


_MT = RESULTS + """, models as (select run, max(estimate) filter (where section = 'Model_Fit' and parameter = 'LL') as ll, max(estimate) filter (where section = 'Model_Fit' and parameter = 'AIC') as aic,
  max(estimate) filter (where section = 'Model_Fit' and parameter = 'BIC') as bic, cast(count(*) filter (where section = 'Parameters') as bigint) as n_params,
  cast(count(*) filter (where section = 'Parameters' and p_value < 0.05) as bigint) as n_significant from results group by run)"""


@query("model_table", doubles="ll aic bic", sql=f"with {_MT} select * from models")
def _(t):
    return models.model_table(results(t), "run")


@query("models_by_complexity", doubles="mean_aic min_aic mean_bic min_bic", sql=f"""with {_MT} select n_params, n_significant, count(*) as n_models, avg(aic) as mean_aic, min(aic) as min_aic, avg(bic) as mean_bic, min(bic) as min_bic
  from models group by all""")
def _(t):
    return models.models_by_complexity(models.model_table(results(t), "run"), ["n_params", "n_significant"])


@query("significant_params", doubles="min_p", sql=f"""with {RESULTS} select run, count(*) as n_significant, cast(count(*) filter (where parameter like '%theta%') as bigint) as n_theta,
  cast(count(*) filter (where parameter like '%gamma%') as bigint) as n_gamma, min(p_value) as min_p from results where p_value < 0.3 group by run""")
def _(t):
    return significant_params(results(t), "run", "parameter", "p_value", 0.3)


# restricted and full model per brand; the full one adds two parameters
_LR = RUNS + """, fits as (select run, -sum(n) / 10.0::DOUBLE as ll_r, -sum(n) / 10.0::DOUBLE + 40 * sum(ss) / sum(n) as ll_u from runs group by run)"""


@query("lr_test", doubles="ll_r ll_u lr p_value", sql=f"""with {_LR} select run, ll_r, cast(4 as bigint) as k_r, ll_u, cast(6 as bigint) as k_u, -2 * (ll_r - ll_u) as lr, cast(2 as bigint) as dof, exp(ll_r - ll_u) as p_value from fits""")
def _(t):
    base = runs(t).groupBy("run").agg((-F.sum("n") / 10.0).alias("ll"), (40 * F.sum("ss") / F.sum("n")).alias("gain"))
    small = base.select("run", "ll", F.lit(4).cast("bigint").alias("n_params"))
    full = base.select("run", (F.col("ll") + F.col("gain")).alias("ll"), F.lit(6).cast("bigint").alias("n_params"))
    return models.lr_test(small, full, ["run"])


@query("rank_models", doubles="ll aic bic", sql=f"with {_MT} select *, cast(row_number() over (order by aic, run) as integer) as rank from models order by aic, run limit 10")
def _(t):
    return models.rank_models(models.model_table(results(t), "run"), "aic", "run", 10)


@query("path_summary", doubles="mean sd", sql=f"""with {PATHS}, z as (select lval, estimate, estimate / std_err as z from paths)
  select lval, count(*) as n_paths, avg(estimate) as mean, stddev_samp(estimate) as sd, cast(count(*) filter (where 2 * {sql_norm_cdf('(-abs(z))')} < 0.05) as bigint) as n_significant from z group by lval""")
def _(t):
    p = paths(t).withColumn("p_value", two_sided_p(F.col("estimate") / F.col("std_err")))
    return models.path_summary(p, "lval", "estimate", "p_value")


@query("t_and_p", doubles="estimate:13 std_error:13 t p_value:9", sql=f"with {RUNS}, z as (select run, parameter, estimate, std_error, estimate / std_error as t from runs) select *, 2 * {sql_norm_cdf('(-abs(t))')} as p_value from z")
def _(t):
    return models.t_and_p(runs(t).select("run", "parameter", "estimate", "std_error"), "estimate", "std_error")


_COEF = RUNS + """, z as (select run, parameter, estimate - 0.0497123 as estimate, std_error, (estimate - 0.0497123) / std_error as z from runs)"""


def _coefs(t):
    return runs(t).select("run", "parameter", (F.col("estimate") - 0.0497123).alias("estimate"), "std_error")


@query("coef_table", doubles="estimate:13 std_error:13 z p_value:9 ci_low:9 ci_high:9", sql=f"""with {_COEF}, p as (select *, 2 * {sql_norm_cdf('(-abs(z))')} as p_value from z)
  select *, estimate - 1.959963984540054 * std_error as ci_low, estimate + 1.959963984540054 * std_error as ci_high,
    case when p_value < 0.001 then '***' when p_value < 0.01 then '**' when p_value < 0.05 then '*' else '' end as stars from p""")
def _(t):
    return models.coef_table(_coefs(t), "estimate", "std_error")


@query("odds_ratios", doubles="estimate:13 std_error:13 odds_ratio or_low or_high", sql=f"""with {_COEF} select run, parameter, estimate, std_error, exp(estimate) as odds_ratio, exp(estimate - 1.959963984540054 * std_error) as or_low,
  exp(estimate + 1.959963984540054 * std_error) as or_high, case when estimate > 0 then 'increases' when estimate < 0 then 'decreases' else 'no effect' end as direction from z""")
def _(t):
    return models.odds_ratios(_coefs(t), "estimate", "std_error")


@query("coef_interpretation", sql=f"""with {_COEF}, p as (select *, 2 * {sql_norm_cdf('(-abs(z))')} as p from z) select run, parameter,
  case when estimate > 0 then 'positive' when estimate < 0 then 'negative' else 'none' end as direction, p < 0.05 as significant,
  case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars,
  case when p < 0.05 and estimate > 0 then 'raises choice' when p < 0.05 and estimate < 0 then 'lowers choice' else 'no significant effect' end as reading from p""")
def _(t):
    c = models.t_and_p(_coefs(t), "estimate", "std_error")
    return models.coef_interpretation(c, "estimate", "p_value").select("run", "parameter", "direction", "significant", "stars", "reading")


@query("wtp", doubles="wtp:5", sql=f"with {RUNS} select a.run, a.parameter, -a.estimate / nullif(b.estimate, 0) as wtp from runs a join runs b on a.run = b.run and b.parameter = 'MEDIUM' where a.parameter <> 'MEDIUM'")
def _(t):
    return models.wtp(runs(t), ["run"], "parameter", "estimate", "MEDIUM")


@query("fit_statistics", doubles="ll null_ll aic bic rho2 adj_rho2", sql=f"""with {LONG}, s as (select sid, count(*) as j from long group by sid),
  f as (select count(*) as n_sets, -sum(ln(j)) as null_ll, -0.9::DOUBLE * sum(ln(j)) as ll, cast(3 as bigint) as k from s)
  select *, -2 * ll + 2 * k as aic, -2 * ll + k * ln(n_sets) as bic, 1 - ll / null_ll as rho2, 1 - (ll - k) / null_ll as adj_rho2 from f""")
def _(t):
    sets = choice_rows(t).groupBy("sid").agg(F.count(F.lit(1)).alias("j"))
    f = sets.agg(F.count(F.lit(1)).alias("n_sets"), (-F.sum(F.log("j"))).alias("null_ll")).withColumns(
        {"ll": 0.9 * F.col("null_ll"), "k": F.lit(3).cast("bigint")})
    return models.fit_statistics(f, "ll", "k", "n_sets", "null_ll")


@query("modification_top", doubles="mi", sql=f"""with {PATHS} select model, lval, rval, abs(estimate) as mi from paths where abs(estimate) >= 0.001
  order by mi desc, model, lval, rval limit 5""")
def _(t):
    p = paths(t).select("model", "lval", "rval", F.abs("estimate").alias("mi"))
    return modification_filter(p, "mi", 0.001, 5, ["model", "lval", "rval"])
