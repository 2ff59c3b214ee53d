"""Utilities, probabilities, likelihoods, scores and draws at fixed parameters on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, factor_terms, kernels, measurement, models, stats, utility
from ..operators.stats import describe_columns, inline
from ..functions.normal import norm_cdf, norm_pdf, norm_ppf
from ..functions.vector import digit_maps, digits_for
from .bindings import (COMPLETE, FACTORS, ITEMS, LOADINGS, LONG, OPT, SCALED, SCORES, choice_long, choice_rows, complete_scores, items, scaled, scores, sets_are_hot,
                       sql_norm_cdf, sql_norm_pdf, sql_norm_ppf, with_opt_out)
from .describe import RICH, rich
from .registry import query

BETA = {"p": -0.05, "d": 0.2, "x": 0.1}
MNL = SCALED + """, v as (select *, -0.05::DOUBLE * p + 0.2::DOUBLE * d + 0.1::DOUBLE * x as v from scaled),
  e as (select *, exp(v - max(v) over (partition by sid)) as e from v), pr as (select *, e / sum(e) over (partition by sid) as prob from e)"""


def with_v(t, numbered=False):
    df = scaled(choice_long(t) if numbered else choice_rows(t))
    return df.withColumn("v", utility.linear(BETA))


@query("flagship", doubles="share mean_prob ll", sql=f"""with {LONG}, z as (select *, (price - avg(price) over ()) / stddev_pop(price) over () as price_z from long),
  e as (select *, exp(-0.5::DOUBLE * price_z - max(-0.5::DOUBLE * price_z) over (partition by sid)) as e from z), pr as (select *, e / sum(e) over (partition by sid) as prob from e)
  select label, count(*) as n_shown, cast(sum(chosen) as bigint) as n_chosen, sum(chosen) / (select sum(chosen) from long)::DOUBLE as share, avg(prob) as mean_prob,
    sum(case when chosen = 1 then ln(least(greatest(prob, 1e-10), 1 - 1e-10)) else 0 end) as ll from pr group by label""")
def _(t):
    z = encode.zscore_pop(choice_rows(t), ["price"])
    p = utility.softmax_prob(z.withColumn("v", utility.utility_basic(0.0, {"price_z": -0.5})), ["sid"], "v", split=sets_are_hot(t))
    from ..functions.scalars import clip_prob
    per = p.groupBy("label").agg(F.count("*").alias("n_shown"), F.sum("chosen").alias("n_chosen"), F.avg("prob").alias("mean_prob"),
                                 F.sum(F.when(F.col("chosen") == 1, F.log(clip_prob(F.col("prob")))).otherwise(0.0)).alias("ll"))
    return per.withColumn("share", F.col("n_chosen").cast("double") / per.agg(F.sum("n_chosen")).scalar())


# ---- utilities -------------------------------------------------------------------------------------------


@query("component_utility", doubles="sugar:10 label:10 price_part:10", sql=f"""with {RICH} select sid, count(*) as n, sum(0.8::DOUBLE * a + 0.3::DOUBLE * a * h) as sugar, sum(0.5::DOUBLE * h) as label, sum(-0.00001::DOUBLE * price) as price_part from rich group by sid""")
def _(t):
    df = rich(t).select("sid", utility.component_utility({"a": 0.8}, {("a", "h"): 0.3}).alias("sugar"), utility.component_utility({"h": 0.5}).alias("label"),
                        utility.component_utility({"price": -0.00001}).alias("price_part"))
    return df.groupBy("sid").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("sugar", "label", "price_part")])


@query("factor_utility", doubles="u:12", sql=f"""with {RICH} select sid, count(*) as n, sum(0.5 * coalesce(0.4::DOUBLE * sa + 0.1::DOUBLE * sa * a + 0.2::DOUBLE * sa * h - 0.000001::DOUBLE * sa * price, 0)) as u from rich group by sid""")
def _(t):
    df = rich(t).select("sid", utility.factor_utility("sa", 0.4, {"a": 0.1, "h": 0.2, "price": -0.000001}, 0.5).alias("u"))
    return df.groupBy("sid").agg(F.count("*").alias("n"), F.sum("u").alias("u"))


@query("factor_integration", doubles="A:6 B:6 factor_utility:6", sql=f"""with {LOADINGS}, {SCALED}, coef as (select corr(p, chosen) as cp, corr(d, chosen) as cd, avg(chosen) as share from scaled),
  lam as (select max(loading) filter (where item = 'q1') as l1, max(loading) filter (where item = 'q2') as l2, max(loading) filter (where item = 'q3') as l3, max(loading) filter (where item = 'q4') as l4,
    max(loading) filter (where item = 'q5') as l5, max(loading) filter (where item = 'q6') as l6, max(loading) filter (where item = 'q7') as l7 from loadings),
  who as (select id, (l1 * q1 + l2 * q2 + l3 * q3 + l4 * q4) / (l1 * l1 + l2 * l2 + l3 * l3 + l4 * l4) as A, (l5 * q5 + l6 * q6 + l7 * q7) / (l5 * l5 + l6 * l6 + l7 * l7) as B from items, lam)
  select sid, count(*) as n, sum(A) as A, sum(B) as B, sum(0.5::DOUBLE * (share * A + cp * A * p) + share * B + cp * B * p + cd * B * d) as factor_utility from scaled join who on scaled.id = who.id, coef group by sid""")
def _(t):
    """Loadings and coefficients come from tables, not from the program."""
    long = scaled(choice_rows(t))
    coef = long.agg(F.corr("p", F.col("chosen").cast("double")).alias("p"), F.corr("d", F.col("chosen").cast("double")).alias("d"), F.avg("chosen").alias("share"))
    row = lambda f, role, name, v: {"factor": F.lit(f), "role": F.lit(role), "name": F.lit(name), "value": v}
    terms = inline(coef, [], [row("A", "direct", "", F.col("share")), row("B", "direct", "", F.col("share")), row("A", "interaction", "p", F.col("p")),
                              row("B", "interaction", "p", F.col("p")), row("B", "interaction", "d", F.col("d")), row("A", "weight", "", F.lit(0.5))])
    spec = terms.unionByName(stats.item_total_loadings(items(t), FACTORS).select("factor", F.lit("item").alias("role"), F.col("item").alias("name"), F.col("loading").alias("value")))
    rows = factor_terms.integrate_factors(long, items(t), "id", spec)
    return rows.groupBy("sid").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("A", "B", "factor_utility")])


@query("total_utility", doubles="additive:10 multiplicative:10", sql=f"""with {RICH} select sid, sum(2 * u_sugar + u_label + u_price) as additive, sum((1 + 2 * u_sugar) * (1 + u_label) * (1 + u_price) - 1) as multiplicative from rich group by sid""")
def _(t):
    parts, w = ["u_sugar", "u_label", "u_price"], {"u_sugar": 2.0}
    df = rich(t).select("sid", utility.total_utility(parts, w).alias("additive"), utility.total_utility(parts, w, "multiplicative").alias("multiplicative"))
    return df.groupBy("sid").agg(F.sum("additive").alias("additive"), F.sum("multiplicative").alias("multiplicative"))


@query("utility_decomposition", doubles="mean sd min max", sql=f"with {RICH}, u as (select 2 * u_sugar as sugar, u_label as label, 2 * u_sugar + u_label as total_utility from rich) " + " union all ".join(
    f"select '{c}' as column_name, count(*) as n, avg({c}) as mean, stddev_samp({c}) as sd, cast(min({c}) as double) as min, cast(max({c}) as double) as max, count(distinct {c}) as n_distinct from u" for c in ("sugar", "label", "total_utility")))
def _(t):
    df = utility.utility_decomposition(rich(t).select("u_sugar", "u_label"), {"sugar": F.col("u_sugar"), "label": F.col("u_label")}, {"sugar": 2.0})
    return describe_columns(df, ["sugar", "label", "total_utility"])


def sql_uniform(*parts: str) -> str:
    """The keyed uniform of ``hash_unit`` in SQL."""
    text = " || ':' || ".join(parts)
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


@query("error_draw", doubles="gumbel:7 logistic:7 normal:7", sql=f"""with {LONG}, u as (select sid, alt, {sql_uniform('sid', 'alt', "'42'")} as u, {sql_uniform('sid', 'alt', "'43'")} as v from long)
  select sid, alt, -ln(-ln(u)) as gumbel, 0.5::DOUBLE * ln(v / (1 - v)) as logistic, 2 * {sql_norm_ppf('v')} as normal from u""")
def _(t):
    df = utility.error_draw(choice_long(t).select("sid", "alt"), "gumbel", 1.0, ["sid", "alt"], 42, "gumbel")
    df = utility.error_draw(df, "logistic", 0.5, ["sid", "alt"], 43, "logistic")
    return utility.error_draw(df, "normal", 2.0, ["sid", "alt"], 43, "normal")


@query("error_draw_correlated", doubles="error:7", sql=f"""with {LONG}, u as (select sid, alt, {sql_uniform('sid', "'common42'")} as u, {sql_uniform('sid', 'alt', "'own42'")} as v from long)
  select sid, alt, 1.5::DOUBLE * (sqrt(0.6::DOUBLE) * {sql_norm_ppf('u')} + sqrt(0.4::DOUBLE) * {sql_norm_ppf('v')}) as error from u""")
def _(t):
    return utility.error_draw_correlated(choice_long(t).select("sid", "alt"), 1.5, 0.6, ["sid"], "alt", 42)


@query("logistic_prob", doubles="prob", sql=f"with {RICH} select sid, alt, 1 / (1 + exp(-u)) as prob from rich")
def _(t):
    df = choice_long(t).withColumn("u", 0.8 * (F.col("label") == "A").cast("int") + 0.5 * (F.col("disc") > 0.05).cast("int") - 0.00001 * F.col("price"))
    return df.select("sid", "alt", utility.logistic_prob(F.col("u")).alias("prob"))


_V = OPT + ", " + SCORES + ", w as (select opt.id, sid, alt, label, price / 10000 as p, disc * 10 as d, sa, sb from opt join scores on opt.id = scores.id)"


def _vrows(t):
    o = with_opt_out(choice_long(t)).withColumns({"p": F.col("price") / 10000, "d": F.col("disc") * 10})
    return o.join(scores(t).select("id", "sa", "sb"), "id").select("sid", "alt", "label", "p", "d", "sa", "sb")


@query("utility_asc_label", doubles="v:10", sql=f"""with {_V} select sid, alt, case when p is null or d is null then 0::DOUBLE when label = 'A' then 0.4 - 0.1::DOUBLE * p + 0.2::DOUBLE * d + 0.3::DOUBLE * sa + 0.05::DOUBLE * sa * p
  when label = 'N' then 0.1 - 0.1::DOUBLE * p + 0.2::DOUBLE * d + 0.2::DOUBLE * sa else 0::DOUBLE end as v from w""")
def _(t):
    v = utility.utility_asc("label", {"A": 0.4, "N": 0.1}, {"p": -0.1, "d": 0.2}, {"A": {"sa": 0.3}, "N": {"sa": 0.2}}, {"A": {("sa", "p"): 0.05}})
    return _vrows(t).select("sid", "alt", v.alias("v"))


@query("utility_asc_position", doubles="v:10", sql=f"""with {_V} select sid, alt, case when p is null or d is null then 0::DOUBLE when alt = 1 then 0.4 - 0.1::DOUBLE * p + 0.2::DOUBLE * d
  when alt = 2 then 0.1 - 0.1::DOUBLE * p + 0.2::DOUBLE * d + 0.2::DOUBLE * sb else 0::DOUBLE end as v from w""")
def _(t):
    return _vrows(t).select("sid", "alt", utility.utility_asc("alt", {1: 0.4, 2: 0.1}, {"p": -0.1, "d": 0.2}, {2: {"sb": 0.2}}).alias("v"))


@query("utility_all_lv", doubles="v:10", sql=f"""with {_V} select sid, alt, case when p is null or d is null then 0::DOUBLE else 0.2 - 0.1::DOUBLE * p + 0.2::DOUBLE * d + 0.3::DOUBLE * sa - 0.2::DOUBLE * sb + 0.05::DOUBLE * sb * d end as v from w""")
def _(t):
    return _vrows(t).select("sid", "alt", utility.utility_all_lv(0.2, {"p": -0.1, "d": 0.2}, {"sa": 0.3, "sb": -0.2}, {("sb", "d"): 0.05}).alias("v"))


@query("utility_moderated", doubles="v:10", sql=f"""with {_V} select sid, alt, case when p is null or d is null then 0::DOUBLE else 0.2 - 0.1::DOUBLE * p + 0.2::DOUBLE * d + 0.3::DOUBLE * sa + 0.1::DOUBLE * sa * sb end as v from w""")
def _(t):
    return _vrows(t).select("sid", "alt", utility.utility_moderated(0.2, {"p": -0.1, "d": 0.2}, "sa", 0.3, {"sb": 0.1}).alias("v"))


@query("utility_basic", doubles="v:10", sql=f"""with {_V} select sid, alt, case when p is null or d is null then 0::DOUBLE else 0.2 - 0.1::DOUBLE * p + 0.2::DOUBLE * d + 0.3::DOUBLE * sa end as v from w""")
def _(t):
    return _vrows(t).select("sid", "alt", utility.utility_basic(0.2, {"p": -0.1, "d": 0.2}, "sa", 0.3).alias("v"))


# ---- probabilities and likelihoods -------------------------------------------------------------------------


@query("softmax_prob", doubles="prob", sql=f"with {MNL} select sid, alt, prob from pr")
def _(t):
    return utility.softmax_prob(with_v(t, True), ["sid"], "v", split=sets_are_hot(t)).select("sid", "alt", "prob")


@query("mnl_loglik", doubles="ll", sql=f"with {MNL} select label, count(*) as n_sets, sum(ln(least(greatest(prob, 1e-10), 1 - 1e-10))) as ll from pr where chosen = 1 group by label")
def _(t):
    return utility.mnl_loglik(with_v(t), ["sid"], "v", "chosen", ["label"], split=sets_are_hot(t))


_PROBIT = SCALED + ", v as (select *, -0.6 - 0.02::DOUBLE * p + 0.1::DOUBLE * d as v from scaled), f as (select *, least(greatest(" + sql_norm_cdf("v") + ", 1e-10), 1 - 1e-10) as phi from v)"


def _probit_rows(t, numbered=False):
    return scaled(choice_long(t) if numbered else choice_rows(t)).withColumn("v", utility.linear({"p": -0.02, "d": 0.1}, -0.6))


@query("probit_prob", doubles="prob:9", sql=f"with {_PROBIT} select sid, alt, phi as prob from f")
def _(t):
    return _probit_rows(t, True).select("sid", "alt", utility.probit_prob(F.col("v")).alias("prob"))


@query("probit_loglik", doubles="ll", sql=f"with {_PROBIT} select label, count(*) as n, sum(case when chosen = 1 then ln(phi) else ln(1 - phi) end) as ll from f group by label")
def _(t):
    return utility.probit_loglik(_probit_rows(t), "v", "chosen", ["label"])


@query("predict_choice", doubles="prob", sql=f"with {MNL} select sid, alt as predicted, prob from pr qualify row_number() over (partition by sid order by v desc, alt) = 1")
def _(t):
    return utility.predict_choice(utility.softmax_prob(with_v(t, True), ["sid"], "v", split=sets_are_hot(t)), ["sid"], "alt", "prob")


@query("predict_binary", sql=f"with {_PROBIT} select sid, alt, case when phi >= 0.25 then 1 else 0 end as predicted from f")
def _(t):
    df = _probit_rows(t, True).withColumn("phi", utility.probit_prob(F.col("v")))
    return df.select("sid", "alt", utility.predict_binary(F.col("phi"), 0.25).alias("predicted"))


@query("null_loglik", doubles="null_ll", sql="with s as (select l_orderkey, count(*) as j from lineitem group by 1) select count(*) as n_sets, -sum(ln(j)) as null_ll from s")
def _(t):
    return utility.null_loglik(t.lineitem.select("l_orderkey"), ["l_orderkey"])


@query("elasticity_at_mean", doubles="mean elasticity", sql=f"""with {SCALED}, m as (select avg(p) as p, avg(d) as d from scaled), q as (select *, 1 / (1 + exp(-(0.3 - 0.5::DOUBLE * p + 0.4::DOUBLE * d))) as pr from m),
  r as (select 'p' as attribute, p as mean, -0.5::DOUBLE * p * (1 - pr) as elasticity from q union all select 'd', d, 0.4::DOUBLE * d * (1 - pr) from q)
  select *, case when abs(elasticity) > 1 then 'elastic' when abs(elasticity) < 1 then 'inelastic' else 'unit' end as kind from r""")
def _(t):
    return utility.elasticity_at_mean(scaled(choice_rows(t)), {"p": -0.5, "d": 0.4}, 0.3)


@query("marginal_effects", doubles="effect", sql=f"with {MNL} select 'p' as attribute, avg(prob * (1 - prob)) * -0.05::DOUBLE as effect from pr union all select 'd', avg(prob * (1 - prob)) * 0.2::DOUBLE from pr")
def _(t):
    return utility.marginal_effects(utility.softmax_prob(with_v(t), ["sid"], "v", split=sets_are_hot(t)), "prob", {"p": -0.05, "d": 0.2})


# ---- scalar functions ------------------------------------------------------------------------------------


@query("norm_functions", doubles="cdf:9 pdf:9 ppf:7", sql=f"""with b as (select event_id, value / 50 - 1 as z, (value + 0.5) / 500 as u from events)
  select event_id, {sql_norm_cdf('z')} as cdf, {sql_norm_pdf('z')} as pdf, {sql_norm_ppf('u')} as ppf from b""")
def _(t):
    b = t.events.selectExpr("event_id", "value / 50 - 1 as z", "(value + 0.5D) / 500 as u")
    return b.select("event_id", norm_cdf(F.col("z")).alias("cdf"), norm_pdf(F.col("z")).alias("pdf"), norm_ppf(F.col("u")).alias("ppf"))


@query("tail_functions", doubles="chi2_p t_p", sql=f"""with b as (select event_id, value / 20 as x from events) select event_id, exp(-x / 2) as chi2_p, 1 - x / sqrt(2 + x * x) as t_p from b""")
def _(t):
    from ..functions.tails import chi2_sf, t_two_sided
    b = t.events.selectExpr("event_id", "value / 20 as x", "2.0D as two")
    return b.select("event_id", chi2_sf("x", "two").alias("chi2_p"), t_two_sided("x", "two").alias("t_p"))


# ---- measurement -----------------------------------------------------------------------------------------

TAUS = [-1.5, -0.5, 0.5, 1.5]
ETA = ITEMS + ", eta as (select *, balance / 5000 - 1 as eta from items)"


def eta_rows(t):
    return items(t).withColumn("eta", F.col("balance") / 5000 - 1)


def _op_sql(q, zeta):
    up = "case " + " ".join(f"when {q} = {k} then {x}" for k, x in enumerate(TAUS, 1)) + " else 40 end"
    low = "case " + " ".join(f"when {q} = {k + 1} then {x}" for k, x in enumerate(TAUS, 1)) + " else -40 end"
    return f"cast({up} as double) - {zeta}::DOUBLE * eta as u_{q}, cast({low} as double) - {zeta}::DOUBLE * eta as l_{q}"


_OP_ITEMS = {"q1": (0.8, TAUS), "q2": (0.5, TAUS)}
OP = ETA + f", cut as (select *, {_op_sql('q1', 0.8)}, {_op_sql('q2', 0.5)} from eta), op as (select *, " + ", ".join(
    f"least(greatest({sql_norm_cdf('u_' + q)} - {sql_norm_cdf('l_' + q)}, 1e-10), 1 - 1e-10) as p_{q}" for q in _OP_ITEMS) + " from cut)"


@query("ordered_probit_prob", doubles="p_q1:9 p_q2:9", sql=f"with {OP} select id, p_q1, p_q2 from op")
def _(t):
    return measurement.ordered_probit_prob(eta_rows(t), "eta", _OP_ITEMS).select("id", "p_q1", "p_q2")


@query("ordered_probit_loglik", doubles="ll", sql=f"with {OP} select segment, count(*) as n, sum(ln(p_q1) + ln(p_q2)) as ll from op group by segment")
def _(t):
    return measurement.ordered_probit_loglik(eta_rows(t), "eta", _OP_ITEMS, ["segment"])


@query("ordered_probit_predict", sql=f"""with {ETA}, g as (select id, k.range as k, cast(case k.range when 1 then -1.5 when 2 then -0.5 when 3 then 0.5 when 4 then 1.5 else 40 end as double) - 2.5::DOUBLE * eta as u,
    cast(case k.range when 2 then -1.5 when 3 then -0.5 when 4 then 0.5 when 5 then 1.5 else -40 end as double) - 2.5::DOUBLE * eta as l from eta, range(1, 6) k),
  p as (select id, k, least(greatest({sql_norm_cdf('u')} - {sql_norm_cdf('l')}, 1e-10), 1 - 1e-10) as p from g)
  select id, cast(k as integer) as predicted from p qualify row_number() over (partition by id order by p desc, k) = 1""")
def _(t):
    return measurement.ordered_probit_predict(eta_rows(t), "eta", 2.5, TAUS).select("id", "predicted")


_GM = {"q1": (0.8, 1.2), "q2": (0.6, 0.9)}


@query("gaussian_measure_loglik", doubles="ll", sql=f"""with {ETA} select segment, count(*) as n, sum(-0.5 * ln(2 * pi() * 1.2) - power(q1 - 0.8::DOUBLE * eta, 2) / 2.4 - 0.5 * ln(2 * pi() * 0.9) - power(q2 - 0.6::DOUBLE * eta, 2) / 1.8) as ll
  from eta group by segment""")
def _(t):
    return measurement.gaussian_measure_loglik(eta_rows(t), "eta", _GM, ["segment"])


@query("measurement_gradient", doubles="d_zeta d_sigma2", sql=f"with {ETA} " + " union all ".join(
    f"select '{q}' as item, sum(({q} - {z}::DOUBLE * eta) * eta / {s}) as d_zeta, sum(-0.5 / {s}::DOUBLE + power({q} - {z}::DOUBLE * eta, 2) / (2 * {s}::DOUBLE * {s}::DOUBLE)) as d_sigma2 from eta" for q, (z, s) in _GM.items()))
def _(t):
    return measurement.measurement_gradient(eta_rows(t), "eta", _GM)


@query("ordered_probit_gradient", doubles="d_zeta d_tau2", sql=f"""with {OP}, g as (select *, case when q1 = 5 then 0 else {sql_norm_pdf('u_q1')} end as fu, case when q1 = 1 then 0 else {sql_norm_pdf('l_q1')} end as fl from op)
  select sum(-(fu - fl) * eta / p_q1) as d_zeta, sum(case when q1 = 2 then fu / p_q1 when q1 = 3 then -fl / p_q1 else 0 end) as d_tau2 from g""")
def _(t):
    s = measurement.ordered_probit_scores(eta_rows(t), "eta", {"q1": (0.8, TAUS)})
    return s.agg(F.sum("s_q1_zeta").alias("d_zeta"), F.sum("s_q1_tau_2").alias("d_tau2"))


_EQ = [("e1", {"x1": 0.5}, 1.0, "z1"), ("e2", {"e1": 0.4, "x1": 0.2}, 0.81, "z2")]
_ST = ITEMS + """, st as (select id, segment, balance / 5000 - 1 as x1, q1 - 3 as z1, q5 - 3 as z2 from items), s1 as (select *, 0.5::DOUBLE * x1 + z1 as e1 from st),
  s2 as (select *, 0.4::DOUBLE * e1 + 0.2::DOUBLE * x1 + 0.9::DOUBLE * z2 as e2 from s1)"""


def _struct(t):
    base = items(t).selectExpr("id", "segment", "balance / 5000 - 1 as x1", "cast(q1 - 3 as double) as z1", "cast(q5 - 3 as double) as z2")
    return measurement.structural_predict(base, _EQ)


@query("structural_predict", doubles="e1 e2", sql=f"with {_ST} select id, e1, e2 from s2")
def _(t):
    return _struct(t).select("id", "e1", "e2")


@query("structural_loglik", doubles="ll", sql=f"""with {_ST} select segment, count(*) as n, sum(-0.5 * ln(2 * pi()) - power(e1 - 0.5::DOUBLE * x1, 2) / 2
  - 0.5 * ln(2 * pi() * 0.81) - power(e2 - (0.4::DOUBLE * e1 + 0.2::DOUBLE * x1), 2) / 1.62) as ll from s2 group by segment""")
def _(t):
    return measurement.structural_loglik(_struct(t), [(e, g, s) for e, g, s, _ in _EQ], ["segment"])


@query("structural_gradient", doubles="d_gamma", sql=f"""with {_ST}, g as (select *, z1 + 0.4::DOUBLE * z2 as t1, z2 as t2 from s2)
  select 'e1' as eta, 'x1' as predictor, sum(t1 * x1) as d_gamma from g union all select 'e2', 'e1', sum(t2 * e1) from g union all select 'e2', 'x1', sum(t2 * x1) from g""")
def _(t):
    return measurement.structural_gradient(_struct(t), [(e, g, s) for e, g, s, _ in _EQ], {"e1": "z1", "e2": "z2"})


@query("structural_ols", doubles="gamma_sa gamma_sb sigma2 r2", sql=f"""with {COMPLETE}, m as (select count(*) as n, sum(sc * sc) as yy, sum(sa * sa) as aa, sum(sb * sb) as bb, sum(sa * sb) as ab, sum(sa * sc) as ay, sum(sb * sc) as byy, var_pop(sc) as vy from complete),
  g as (select *, (bb * ay - ab * byy) / (aa * bb - ab * ab) as g0, (aa * byy - ab * ay) / (aa * bb - ab * ab) as g1 from m)
  select n, g0 as gamma_sa, g1 as gamma_sb, (yy - g0 * ay - g1 * byy) / (n - 2) as sigma2, 1 - (yy - g0 * ay - g1 * byy) / (n * vy) as r2 from g""")
def _(t):
    return measurement.structural_ols(complete_scores(t), "sc", ["sa", "sb"])


@query("likelihood_parts", doubles="ll_measure ll_struct ll_total share_measure share_struct", sql=f"""with {ETA}, m as (select id, -0.5 * ln(2 * pi() * 1.2) - power(q1 - 0.8::DOUBLE * eta, 2) / 2.4 - 0.5 * ln(2 * pi() * 0.9) - power(q2 - 0.6::DOUBLE * eta, 2) / 1.8 as a,
    -0.5 * ln(2 * pi()) - power(eta - 0.1::DOUBLE * nation, 2) / 2 as b from eta)
  select id, a as ll_measure, b as ll_struct, a + b as ll_total, false as not_finite, a / (a + b) as share_measure, b / (a + b) as share_struct from m""")
def _(t):
    e = eta_rows(t)
    return measurement.likelihood_parts({"measure": measurement.gaussian_measure_loglik(e, "eta", _GM, ["id"]),
                                         "struct": measurement.structural_loglik(e, [("eta", {"nation": 0.1}, 1.0)], ["id"])}, "id")


# ---- scores ----------------------------------------------------------------------------------------------

KERNEL = MNL + """, g as (select id, sid, sum((chosen - prob) * p) as g_p, sum((chosen - prob) * d) as g_d, sum((chosen - prob) * x) as g_x,
    sum(case when chosen = 1 then ln(least(greatest(prob, 1e-10), 1 - 1e-10)) else 0 end) as ll from pr group by id, sid),
  person as (select id, sum(ll) as ll, sum(g_p) as g_p, sum(g_d) as g_d, sum(g_x) as g_x from g group by id)"""


def relative(t):
    return kernels.relative_design(scaled(choice_rows(t)), ["sid"], list(BETA), "chosen", ["id"], sets_are_hot(t))


@query("mnl_gradient", doubles="gradient", sql=f"with {KERNEL} select 'p' as parameter, sum(g_p) as gradient from g union all select 'd', sum(g_d) from g union all select 'x', sum(g_x) from g")
def _(t):
    return kernels.mnl_gradient(relative(t), ["sid"], BETA)


@query("individual_scores", doubles="ll g_p g_d g_x", sql=f"with {KERNEL} select * from person")
def _(t):
    return kernels.individual_scores(relative(t), "id", ["sid"], BETA)


_OPG = list(BETA)


@query("opg_matrix", doubles="value:5", sql=f"with {KERNEL} " + " union all ".join(f"select '{a}' as row, '{b}' as col, sum(g_{a} * g_{b}) as value from person" for i, a in enumerate(_OPG) for b in _OPG[i:]))
def _(t):
    return kernels.opg_matrix(kernels.individual_scores(relative(t), "id", ["sid"], BETA), [f"g_{a}" for a in _OPG])


@query("hessian_agg", doubles="value:5", sql=f"with {MNL}, h as (select sid, " + ", ".join(
    f"sum(prob * {a}) * sum(prob * {b}) - sum(prob * {a} * {b}) as h_{a}_{b}" for i, a in enumerate(_OPG) for b in _OPG[i:]) + " from pr group by sid) " + " union all ".join(
    f"select '{a}' as row, '{b}' as col, sum(h_{a}_{b}) as value from h" for i, a in enumerate(_OPG) for b in _OPG[i:]))
def _(t):
    return kernels.hessian_agg(relative(t), ["sid"], BETA)


@query("individual_gradient_profile", doubles="mean sd near_zero positive negative", sql=f"with {KERNEL} " + " union all ".join(
    f"select 'g_{a}' as parameter, count(*) as n, avg(g_{a}) as mean, stddev_samp(g_{a}) as sd, avg(case when abs(g_{a}) < 0.001 then 1::DOUBLE else 0 end) as near_zero, avg(case when g_{a} > 1e-12 then 1::DOUBLE else 0 end) as positive, avg(case when g_{a} < -1e-12 then 1::DOUBLE else 0 end) as negative from person" for a in _OPG))
def _(t):
    from ..operators.iterations import individual_gradient_profile
    s = kernels.individual_scores(relative(t), "id", ["sid"], BETA)
    # exact zeros of single-alternative sets carry rounding noise in either engine
    s = s.select("id", *[F.when(F.abs(f"g_{a}") < 1e-12, 0.0).otherwise(F.col(f"g_{a}")).alias(f"g_{a}") for a in BETA])
    return individual_gradient_profile(s, [f"g_{a}" for a in BETA])


@query("probit_gradient", doubles="gradient:5", sql=f"""with {_PROBIT}, w as (select *, (chosen - phi) * {sql_norm_pdf('v')} / (phi * (1 - phi)) as w from f)
  select 'p' as parameter, sum(w * p) as gradient from w union all select 'd', sum(w * d) from w""")
def _(t):
    return kernels.probit_gradient(_probit_rows(t), "v", "chosen", ["p", "d"])


# ---- draws and simulated likelihood ------------------------------------------------------------------------

R = 8


def _radical_sql(i, base):
    return " + ".join(f"(({i} // {base ** j}) % {base}) / {float(base ** (j + 1))!r}::DOUBLE" for j in range(40 if base == 2 else 26))


DRAWS = f"""who as (select distinct o_custkey as id from orders join lineitem on l_orderkey = o_orderkey), idx as (select id, row_number() over (order by id) - 1 as idx from who),
  pts as (select id, cast(r.range as integer) as r, idx * {R} + r.range + 1 as i from idx, range({R}) r), uni as (select id, r, {_radical_sql('i', 2)} as u1, {_radical_sql('i', 3)} as u2 from pts),
  draws as (select id, r, {sql_norm_ppf('u1')} as z1, {sql_norm_ppf('u2')} as z2 from uni)"""


def draws(t, dims=2):
    who = t.lineitem.select("l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"))
    return kernels.halton_draws(kernels.index_individuals(who, "id"), "id", R, dims)


@query("halton_draws", doubles="z1 z2", sql=f"with {DRAWS} select id, r, z1, z2 from draws")
def _(t):
    return draws(t)


SCRAMBLE, POINTS = 7, 2 ** 20 - 1


def _scrambled_sql(i, base):
    maps = digit_maps(base, digits_for(POINTS, base), SCRAMBLE)
    return " + ".join(f"((({i} // {base ** j}) % {base} * {a} + {c}) % {base}) / {float(base ** (j + 1))!r}::DOUBLE" for j, (a, c) in enumerate(maps)) + f" + {0.5 * float(base) ** -len(maps)!r}::DOUBLE"


@query("halton_scrambled", doubles="z1 z2", sql=f"with {DRAWS.split('uni as')[0]} uni as (select id, r, {_scrambled_sql('i', 2)} as u1, {_scrambled_sql('i', 3)} as u2 from pts) select id, r, {sql_norm_ppf('u1')} as z1, {sql_norm_ppf('u2')} as z2 from uni")
def _(t):
    who = t.lineitem.select("l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"))
    return kernels.halton_draws(kernels.index_individuals(who, "id"), "id", R, 2, scramble=SCRAMBLE, largest=POINTS)


@query("random_draws", doubles="z1:7 z2:7", sql=f"""with u as (select c_custkey as id, cast(r.range as integer) as r, {sql_uniform('c_custkey', 'r.range', "'0'", "'7'")} as u, {sql_uniform('c_custkey', 'r.range', "'1'", "'7'")} as v
    from customer, range({R}) r) select id, r, {sql_norm_ppf('u')} as z1, {sql_norm_ppf('v')} as z2 from u""")
def _(t):
    return kernels.random_draws(t.customer.select(F.col("c_custkey").alias("id")), "id", R, 2, 7)


# logit with a random price coefficient: b = -0.05 + 0.1 z1
DRAW_LL = SCALED + ", " + DRAWS + """, dv as (select long2.id, sid, r, chosen, (-0.05 + 0.1::DOUBLE * z1) * p + 0.2::DOUBLE * d as v from scaled long2 join draws on long2.id = draws.id),
  de as (select id, sid, r, max(v) filter (where chosen = 1) - (max(v) + ln(sum(exp(v - mv)))) as lp from (select *, max(v) over (partition by id, sid, r) as mv from dv) group by id, sid, r),
  drawll as (select id, r, sum(least(greatest(lp, ln(1e-10)), ln(1 - 1e-10))) as ll from de group by id, r)"""


def draw_lls(t):
    rel = kernels.relative_design(scaled(choice_rows(t)), ["sid"], ["p", "d"], "chosen", ["id"], sets_are_hot(t))
    coefs = draws(t, 1).withColumns({"b_p": -0.05 + 0.1 * F.col("z1"), "b_d": F.lit(0.2)})
    return kernels.draw_choice(rel, coefs, ["id"], ["sid"], ["p", "d"], ["z1"])


@query("draw_loglik", doubles="ll", sql=f"with {DRAW_LL} select id, r, ll from drawll")
def _(t):
    return draw_lls(t).select("id", "r", "ll")


@query("simulated_loglik", doubles="ll", sql=f"with {DRAW_LL}, m as (select *, max(ll) over (partition by id) as m from drawll) select id, max(m) + ln(sum(exp(ll - m))) - ln({R}) as ll from m group by id")
def _(t):
    return kernels.simulated_loglik(draw_lls(t), "id", R)


_W = DRAW_LL + ", wm as (select *, exp(ll - max(ll) over (partition by id)) as e from drawll), wt as (select *, e / sum(e) over (partition by id) as w from wm)"


@query("importance_weights", doubles="w", sql=f"with {_W} select id, r, w from wt")
def _(t):
    return kernels.importance_weights(draw_lls(t), "id").select("id", "r", "w")


@query("posterior_scores", doubles="z1", sql=f"with {_W} select wt.id, sum(w * z1) as z1 from wt join draws on wt.id = draws.id and wt.r = draws.r group by wt.id")
def _(t):
    return kernels.posterior_scores(kernels.importance_weights(draw_lls(t), "id"), "id", ["z1"])


@query("gradient_table", doubles="gradient:5 t p_value", sql=f"""with {KERNEL}, s as (select 'p' as parameter, sum(g_p) as gradient, sqrt(sum(g_p * g_p)) as se from person union all select 'd', sum(g_d), sqrt(sum(g_d * g_d)) from person),
  z as (select parameter, gradient, gradient / se as t from s) select *, 2 * {sql_norm_cdf('(-abs(t))')} as p_value from z""")
def _(t):
    from ..operators.stats import inline
    s = kernels.individual_scores(relative(t), "id", ["sid"], BETA)
    one = s.agg(*[e for a in ("p", "d") for e in (F.sum(f"g_{a}").alias(a), F.sqrt(F.sum(F.col(f"g_{a}") * F.col(f"g_{a}"))).alias(f"se_{a}"))])
    rows = inline(one, [], [{"parameter": F.lit(a), "gradient": F.col(a), "se": F.col(f"se_{a}")} for a in ("p", "d")])
    return models.t_and_p(rows, "gradient", "se").drop("se")
