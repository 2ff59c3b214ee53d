"""Paths, mediation, moderation, resampling and latent models on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..estimators import latent
from ..functions.normal import two_sided_p
from ..operators import kernels, mediation, paths as pt, resample, stats
from ..operators.shape import compare_estimates
from .bindings import (COMPLETE, FACTORS, ITEM_COLS, ITEMS, LOADINGS, NODES, PATHS, REPLICATES, SCORES, choice_rows, complete_scores,
                       items, nodes, paths, replicates, scaled, scores, sets_are_hot, sql_norm_cdf, sql_norm_ppf)
from .registry import query

# ---- effects along paths -----------------------------------------------------------------------------------

_E = "(select estimate from paths q where q.model = p.model and q.rval = '{}' and q.lval = '{}')"
MED = PATHS + """, med as (select a.model, a.rval as x, a.lval as m, b.lval as y, a.estimate as a, b.estimate as b, a.std_err as sa_, b.std_err as sb_
  from paths a join paths b on a.model = b.model and a.lval = b.rval and a.rval <> b.lval)"""


@query("effect_direct", doubles="direct", sql=f"with {PATHS} select model, rval as x, lval as y, estimate as direct from paths where rval = 'sa' and lval = 'sd'")
def _(t):
    return pt.effect_direct(paths(t), ["model"], "sa", "sd")


@query("effect_indirect", doubles="a b indirect", sql=f"with {MED} select model, x, m, y, a, b, a * b as indirect from med where x = 'sa' and y = 'sd' and m in ('sb', 'sc')")
def _(t):
    return pt.effect_indirect(paths(t), ["model"], "sa", "sd", ["sb", "sc"])


@query("effect_total", doubles="indirect direct total proportion_mediated", sql=f"""with {MED}, i as (select model, sum(a * b) as indirect from med where x = 'sa' and y = 'sd' and m in ('sb', 'sc') group by model),
  j as (select i.model, indirect, estimate as direct from i join paths p on p.model = i.model and p.rval = 'sa' and p.lval = 'sd')
  select *, direct + indirect as total, indirect / (direct + indirect) as proportion_mediated from j""")
def _(t):
    return pt.effect_total(paths(t), ["model"], "sa", "sd", ["sb", "sc"])


@query("effect_serial", doubles="effect:9", sql=f"""with {PATHS} select a.model, a.lval as m1, d.lval as m2, a.estimate * d.estimate * b.estimate as effect from paths a
  join paths d on a.model = d.model and d.rval = a.lval join paths b on b.model = a.model and b.rval = d.lval
  where a.rval = 'sa' and a.lval in ('sb', 'sc') and d.lval in ('sb', 'sc') and a.lval <> d.lval and b.lval = 'sd'""")
def _(t):
    return pt.effect_serial(paths(t), ["model"], "sa", "sd", ["sb", "sc"])


_SOBEL = MED + ", s as (select model, x, m, y, a * b as indirect, sqrt(b * b * sa_ * sa_ + a * a * sb_ * sb_) as se from med), z as (select *, indirect / se as z from s)"


@query("sobel", doubles="indirect:9 se:9 z p_value", sql=f"with {_SOBEL} select *, 2 * {sql_norm_cdf('(-abs(z))')} as p_value from z")
def _(t):
    return pt.sobel(paths(t), ["model"])


_SWEEP = _SOBEL + f""", sw as (select z.*, 2 * {sql_norm_cdf('(-abs(z))')} as p_value, p.estimate as direct, p.estimate / p.std_err as zd from z join paths p on p.model = z.model and p.rval = x and p.lval = y),
  sweep as (select *, 2 * {sql_norm_cdf('(-abs(zd))')} as p_direct from sw)"""
_KIND = "case when p_value < 0.05 and p_direct >= 0.05 then 'full' when p_value < 0.05 and p_direct < 0.05 then 'partial' else 'none' end"


@query("mediation_type", sql=f"with {_SWEEP} select model, x, m, y, {_KIND} as mediation from sweep")
def _(t):
    return pt.mediation_type(pt.mediation_sweep(paths(t), ["model"]).drop("mediation"), "p_value", "p_direct").select("model", "x", "m", "y", "mediation")


@query("mediation_sweep", doubles="indirect:9 se:9 z p_value direct p_direct total", sql=f"with {_SWEEP} select model, x, m, y, indirect, se, z, p_value, direct, p_direct, direct + indirect as total, {_KIND} as mediation from sweep")
def _(t):
    return pt.mediation_sweep(paths(t), ["model"])


# ---- moderation ----------------------------------------------------------------------------------------------

# y ~ 1 + x + m: the interaction model's normal equations solved by SQL through the Frisch-Waugh residual of xm
_MOD = COMPLETE + """, mo as (select count(*) as n, avg(sa) as mx, avg(sb) as mm, avg(sa * sb) as mp, avg(sc) as my, var_pop(sa) as vx, var_pop(sb) as vm, covar_pop(sa, sb) as cxm,
    covar_pop(sa, sa * sb) as cxp, covar_pop(sb, sa * sb) as cmp, stddev_samp(sb) as sd from complete),
  bb as (select *, (vm * cxp - cxm * cmp) / (vx * vm - cxm * cxm) as bx, (vx * cmp - cxm * cxp) / (vx * vm - cxm * cxm) as bm from mo),
  rr as (select sa as x, sb as m, sc as y, sa * sb - mp - bx * (sa - mx) - bm * (sb - mm) as r, sa - mx as dx, sb - mm as dm, bb.* from complete, bb),
  b3 as (select sum(r * y) / sum(r * r) as b3, sum(r * r) as rss_r from rr),
  yy as (select x, m, y - b3 * x * m as yt from rr, b3), lin as (select covar_pop(x, yt) as cxy, covar_pop(m, yt) as cmy, avg(yt) as myt from yy),
  co as (select n, mm, sd, b3, (vm * cxy - cxm * cmy) / (vx * vm - cxm * cxm) as b1, (vx * cmy - cxm * cxy) / (vx * vm - cxm * cxm) as b2 from lin, b3, bb)"""


def _fit(t):
    return pt.moderation_fit(complete_scores(t), "sa", "sb", "sc")


@query("moderation_fit", doubles="estimate", sql=f"with {_MOD} select 'x' as term, b1 as estimate, n from co union all select 'm', b2, n from co union all select 'xm', b3, n from co")
def _(t):
    return _fit(t).filter("term <> 'c'").select("term", "estimate", "n")


@query("moderation_controls")
def _(t):
    """With two control variables and centred predictors."""
    whole = complete_scores(t).withColumn("nation", F.col("nation").cast("double"))
    return pt.moderation_fit(whole, "sa", "sb", "sc", controls=["sd", "nation"], centre=True)


@query("moderation_by_segment")
def _(t):
    return pt.moderation_fit(complete_scores(t), "sa", "sb", "sc", ["segment"])


@query("moderation_interpret", doubles="estimate p_value", sql=f"""with {PATHS}, z as (select model, lval, rval, estimate, estimate / std_err as z from paths), p as (select *, 2 * {sql_norm_cdf('(-abs(z))')} as p_value from z)
  select model, lval, rval, 'xm' as term, estimate, p_value, case when p_value >= 0.05 then 'none' when estimate > 0 then 'strengthening' else 'weakening' end as effect from p""")
def _(t):
    z = paths(t).withColumn("z", F.col("estimate") / F.col("std_err"))
    rows = z.select("model", "lval", "rval", F.lit("xm").alias("term"), "estimate", two_sided_p(F.col("z")).alias("p_value"))
    return pt.moderation_interpret(rows)


@query("simple_slopes", doubles="m slope", sql=f"""with {_MOD} select 'low' as level, mm - sd as m, b1 + b3 * (mm - sd) as slope from co union all select 'mean', mm, b1 + b3 * mm from co union all select 'high', mm + sd, b1 + b3 * (mm + sd) from co""")
def _(t):
    return pt.simple_slopes(_fit(t)).select("level", "m", "slope")


@query("conditional_effects", doubles="m slope", sql=f"with {_MOD} " + " union all ".join(
    f"select 'p{round(p * 100)}' as level, (select quantile_cont(sb, {p}) from complete) as m, b1 + b3 * (select quantile_cont(sb, {p}) from complete) as slope from co" for p in (0.1, 0.25, 0.5, 0.75, 0.9)))
def _(t):
    return pt.conditional_effects(_fit(t), complete_scores(t), "sb").select("level", "m", "slope")


@query("moderation_sweep")
def _(t):
    return pt.moderation_sweep(complete_scores(t), NODES)


# ---- resampling ----------------------------------------------------------------------------------------------

B = 20
# the same keyed hash in SQL: 13 hex digits of md5
_U = "((('0x' || substr(md5(b || ':' || slot || ':11'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
WEIGHTS = f"""ids as (select c_custkey as id, row_number() over (order by c_custkey) - 1 as idx from customer), nn as (select count(*) as n from ids),
  picks as (select b, cast(floor({_U} * n) as bigint) as idx from (select cast(r.range as integer) as b, idx as slot from ids, range(1, {B + 1}) r), nn),
  weights as (select b as replicate, id, cast(count(*) as bigint) as w from picks join ids on picks.idx = ids.idx group by b, id)"""


def weights(t):
    return resample.bootstrap_individuals(t.customer.select(F.col("c_custkey").alias("id")), "id", B, 11)


_NODE_CTE = "long as (" + " union all ".join(f"select id, {i} as i, {n}::DOUBLE as v from complete" for i, n in enumerate(NODES)) + ")"
_TRIPLES = f"""{COMPLETE.replace('items.id, segment', 'items.id as id, segment')}, {_NODE_CTE}, dense as (select id, row_number() over (order by id) - 1 as idx from complete), nn as (select count(*) as n from dense),
  picks as (select b, cast(floor({_U} * n) as bigint) as idx from (select cast(r.range as integer) as b, idx as slot from dense, range(1, {B + 1}) r), nn),
  w as (select b as replicate, id, count(*)::DOUBLE as w from picks join dense on picks.idx = dense.idx group by b, id union all select 0, id, 1::DOUBLE from dense),
  one as (select replicate, i, sum(w * v) / sum(w) as mu from w join long on w.id = long.id group by all),
  two as (select replicate, a.i as i, b.i as j, sum(w * a.v * b.v) / sum(w) as s from w join long a on w.id = a.id join long b on w.id = b.id group by all),
  cov as (select two.replicate, two.i, two.j, s - p.mu * q.mu as c from two join one p on p.replicate = two.replicate and p.i = two.i join one q on q.replicate = two.replicate and q.i = two.j),
  eff as (select xm.replicate, xm.i as x, xm.j as m, xy.j as y, (xm.c / xx.c) * (xx.c * my.c - xm.c * xy.c) / (xx.c * mm.c - xm.c * xm.c) as indirect
    from cov xm join cov xy on xy.replicate = xm.replicate and xy.i = xm.i join cov my on my.replicate = xm.replicate and my.i = xm.j and my.j = xy.j
      join cov xx on xx.replicate = xm.replicate and xx.i = xm.i and xx.j = xm.i join cov mm on mm.replicate = xm.replicate and mm.i = xm.j and mm.j = xm.j
    where xm.i <> xm.j and xy.j <> xm.i and xy.j <> xm.j),
  med as materialized (select ({NODES})[x + 1] as x, ({NODES})[m + 1] as m, ({NODES})[y + 1] as y, max(indirect) filter (where replicate = 0) as estimate,
    avg(indirect) filter (where replicate > 0) as mean, stddev_samp(indirect) filter (where replicate > 0) as sd,
    quantile_cont(indirect, 0.025) filter (where replicate > 0) as ci_low, quantile_cont(indirect, 0.975) filter (where replicate > 0) as ci_high from eff group by all)"""


def _mediated(t):
    return mediation.mediation_bootstrap(complete_scores(t).select("id", *NODES), "id", NODES, B, 11)


@query("mediation_bootstrap", doubles="estimate:7 mean:7 sd:7 ci_low:7 ci_high:7", sql=f"with {_TRIPLES} select *, ci_low > 0 or ci_high < 0 as significant, 0::BIGINT as n_failed from med")
def _(t):
    return _mediated(t)


@query("mediation_rate", doubles="rate", sql=f"with {_TRIPLES} select count(*) as n_tested, count(*) filter (where ci_low > 0 or ci_high < 0) as n_significant, avg(case when ci_low > 0 or ci_high < 0 then 1::DOUBLE else 0 end) as rate from med")
def _(t):
    return mediation.mediation_rate(_mediated(t))


@query("bootstrap_individuals", sql=f"with {WEIGHTS} select replicate, id, w from weights")
def _(t):
    return weights(t)


@query("bootstrap_rows", sql=f"""with ids as (select event_id, row_number() over (order by event_id) - 1 as idx from events), nn as (select count(*) as n from events),
  picks as (select b, cast(floor({_U.replace(":11'", ":3'")} * n) as bigint) as idx from (select cast(r.range as integer) as b, idx as slot from ids, range(1, 6) r), nn)
  select b as replicate, event_id, cast(count(*) as bigint) as w from picks join ids on picks.idx = ids.idx group by b, event_id""")
def _(t):
    return resample.bootstrap_rows(t.events.select("event_id"), "event_id", 5, 3)


@query("bootstrap_means", doubles="value", sql=f"""with {WEIGHTS}, per as (select o_custkey as id, sum(o_totalprice) as s, count(*) as c from orders group by 1)
  select replicate, 'o_totalprice' as parameter, sum(w * s) / sum(w * c) as value from weights join per on weights.id = per.id group by replicate""")
def _(t):
    return resample.weighted_means(t.orders.select(F.col("o_custkey").alias("id"), "o_totalprice"), weights(t), "id", ["o_totalprice"])


@query("bootstrap_parametric")
def _(t):
    cov = stats.cov_sufficient_stats(items(t), ITEM_COLS)
    return resample.bootstrap_parametric(cov, ITEM_COLS, 10, 5).groupBy("var1", "var2").agg(F.avg("cov").alias("mean_cov"), F.count("*").alias("n"))


@query("bootstrap_ci", doubles="mean sd p_value ci_low ci_high", sql=f"""with {REPLICATES}, s as (select parameter, count(*) as n, avg(value) as mean, stddev_samp(value) as sd,
    least(1, 2 * least(count(*) filter (where value > 0), count(*) filter (where value < 0)) / count(*)::DOUBLE) as p_value, quantile_cont(value, 0.025) as ci_low, quantile_cont(value, 0.975) as ci_high from replicates group by parameter)
  select *, ci_low > 0 or ci_high < 0 as significant from s""")
def _(t):
    return resample.bootstrap_ci(replicates(t), ["parameter"])


@query("bootstrap_ci_bc", doubles="estimate z0 ci_low ci_high", sql=f"""with {REPLICATES}, e as (select parameter, avg(value) as estimate from replicates group by parameter),
  s as (select r.parameter, max(estimate) as estimate, count(*) as n, count(*) filter (where value < estimate) / count(*)::DOUBLE as share from replicates r join e on r.parameter = e.parameter group by r.parameter),
  z as (select *, {sql_norm_ppf('share')} as z0 from s), a as (select *, 2 * z0 - 1.959963984540054 as l, 2 * z0 + 1.959963984540054 as h from z),
  q as (select parameter, estimate, z0, {sql_norm_cdf('l')} * (n - 1) as kl, {sql_norm_cdf('h')} * (n - 1) as kh from a),
  o as (select parameter, value, row_number() over (partition by parameter order by value) - 1 as k from replicates),
  p as (select q.parameter, max(q.estimate) as estimate, max(z0) as z0, max(kl) as kl, max(kh) as kh, max(value) filter (where k = floor(kl)) as l0, max(value) filter (where k = floor(kl) + 1) as l1,
    max(value) filter (where k = floor(kh)) as h0, max(value) filter (where k = floor(kh) + 1) as h1 from q join o on q.parameter = o.parameter group by q.parameter)
  select parameter, estimate, z0, l0 + coalesce((l1 - l0) * (kl - floor(kl)), 0) as ci_low, h0 + coalesce((h1 - h0) * (kh - floor(kh)), 0) as ci_high from p""")
def _(t):
    r = replicates(t)
    return resample.bootstrap_ci_bc(r, r.groupBy("parameter").agg(F.avg("value").alias("estimate")), ["parameter"])


@query("bootstrap_p", doubles="mean sd p_sign p_sign_plus z p_normal", sql=f"""with {REPLICATES}, s as (select parameter, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, least(count(*) filter (where value <= 0), count(*) filter (where value >= 0)) as k from replicates group by parameter),
  z as (select parameter, n, mean, sd, least(2 * k / n::DOUBLE, 1) as p_sign, least(2 * (k + 1) / (n + 1)::DOUBLE, 1) as p_sign_plus, mean / sd as z from s) select *, 2 * {sql_norm_cdf('(-abs(z))')} as p_normal from z""")
def _(t):
    return resample.bootstrap_p(replicates(t), ["parameter"]).drop("p_t")


@query("bootstrap_stats", doubles="mean sd min max skewness kurtosis q25 median q75", sql=f"""with {REPLICATES}, b as (select parameter, value as x, avg(value) over (partition by parameter) as m from replicates)
  select parameter, count(*) as n, avg(x) as mean, stddev_samp(x) as sd, min(x) as min, max(x) as max, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) as skewness,
    avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3 as kurtosis, quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q75 from b group by parameter""")
def _(t):
    return resample.bootstrap_stats(replicates(t), ["parameter"])


@query("replicate_outcome", sql="""select event_type as parameter, count(*) as n_requested, cast(count(*) filter (where value <= 100) as bigint) as n_success, cast(count(*) filter (where value > 100) as bigint) as n_failed
  from events group by event_type""")
def _(t):
    r = t.events.select(F.col("event_type").alias("parameter"), F.when(F.col("value") <= 100, F.col("value")).alias("value"))
    return resample.replicate_outcome(r, ["parameter"])


# a replicate per segment: item loadings of its customers, every second factor turned round where the balance is low
_SEGLOAD = LOADINGS + ", seg as (" + " union all ".join(
    f"select segment as replicate, '{f}' as factor, '{q}' as item, case when avg(balance) < 4500 then -1 else 1 end * corr({q}, {' + '.join(cols)}) as loading from items group by segment" for f, cols in FACTORS.items() for q in cols) + """),
  dots as (select replicate, seg.factor, sum(seg.loading * loadings.loading) as d from seg join loadings on seg.item = loadings.item group by all)"""


def seg_loadings(t):
    exprs, rows = [], []
    for f, cols in FACTORS.items():
        total = stats.add([F.col(c).cast("double") for c in cols])
        for c in cols:
            exprs.append(F.corr(F.col(c).cast("double"), total).alias(c))
            rows.append({"factor": F.lit(f), "item": F.lit(c), "loading": F.when(F.col("b") < 4500, -F.col(c)).otherwise(F.col(c))})
    return stats.inline(items(t).groupBy(F.col("segment").alias("replicate")).agg(F.avg("balance").alias("b"), *exprs), ["replicate"], rows)


@query("align_loadings", doubles="loading", sql=f"with {_SEGLOAD} select seg.replicate, seg.factor, item, case when d < 0 then -loading else loading end as loading, d < 0 as flipped from seg join dots on seg.replicate = dots.replicate and seg.factor = dots.factor")
def _(t):
    return resample.align_loadings(stats.item_total_loadings(items(t), FACTORS), seg_loadings(t), ["replicate"])


@query("flip_stats", doubles="rate", sql=f"with {_SEGLOAD} select factor, count(*) as n, cast(count(*) filter (where d < 0) as bigint) as n_flipped, avg(case when d < 0 then 1::DOUBLE else 0 end) as rate, avg(case when d < 0 then 1::DOUBLE else 0 end) > 0.3 as unstable from dots group by factor")
def _(t):
    a = resample.align_loadings(stats.item_total_loadings(items(t), FACTORS), seg_loadings(t), ["replicate"])
    return resample.flip_stats(a.select("replicate", "factor", "flipped").distinct(), "factor", "flipped")


_SC = SCORES + ", rep as (select id, segment as replicate, case when segment in ('BUILDING', 'MACHINERY') then -sa else sa + sb / 10 end as score from scores), cr as (select replicate, corr(score, sa) as r from rep join scores on rep.id = scores.id group by replicate)"


@query("align_scores", doubles="score", sql=f"with {_SC} select rep.replicate, id, case when r < 0 then -score else score end as score, r < 0 as flipped from rep join cr on rep.replicate = cr.replicate")
def _(t):
    s = scores(t)
    rep = s.select("id", F.col("segment").alias("replicate"), F.when(F.col("segment").isin("BUILDING", "MACHINERY"), -F.col("sa")).otherwise(F.col("sa") + F.col("sb") / 10).alias("score"))
    return resample.align_scores(s.select("id", F.col("sa").alias("score")), rep, ["replicate"], "id", "score")


@query("procrustes_align")
def _(t):
    it = items(t)
    two = ["A", "B"]

    def loads(df, keys):
        total = {f: stats.add([F.col(c).cast("double") for c in cols]) for f, cols in FACTORS.items()}
        wide = df.groupBy(*keys).agg(*[F.corr(F.col(c).cast("double"), total[f]).alias(f"{c}_{f}") for c in ITEM_COLS for f in two])
        return stats.inline(wide, keys, [{"item": F.lit(c), **{f: F.col(f"{c}_{f}") for f in two}} for c in ITEM_COLS])
    return resample.procrustes_align(loads(it, []), loads(it.withColumnRenamed("segment", "replicate"), ["replicate"]), ["replicate"], two)


@query("bootstrap_stage1")
def _(t):
    fits = resample.bootstrap_stage1(items(t), "id", FACTORS, [("B", "A")], weights(t))
    path = fits.filter("section = 'Parameters' and op = '~' and lval = 'B'").select("replicate", F.lit("A->B").alias("parameter"), F.col("estimate").alias("value"))
    return resample.bootstrap_ci(path, ["parameter"])


def _choice_design(t):
    return kernels.relative_design(scaled(choice_rows(t)), ["sid"], ["p", "d"], "chosen", ["id"], sets_are_hot(t))


@query("bootstrap_stage2")
def _(t):
    reps = resample.bootstrap_stage2(_choice_design(t), "id", ["sid"], {"p": 0.0, "d": 0.0}, weights(t))
    return resample.bootstrap_ci(reps, ["parameter"])


@query("bootstrap_both")
def _(t):
    reps = resample.bootstrap_both(items(t), _choice_design(t), "id", ["sid"], "A", FACTORS["A"], "p", {"p": 0.0, "d": 0.0, "A_x_p": 0.0}, weights(t))
    return resample.bootstrap_ci(reps, ["parameter"])


# ---- latent models -------------------------------------------------------------------------------------------


@query("one_factor_fit")
def _(t):
    return latent.one_factor_fit(items(t), FACTORS)


@query("multi_factor_fit")
def _(t):
    return latent.multi_factor_fit(items(t), FACTORS, ["segment"])


def _sem(t, keys=("segment",)):
    return latent.sem_fit(items(t), FACTORS, [("B", "A")], list(keys))


@query("sem_fit")
def _(t):
    return _sem(t)


# parameter rows from covariances: item on factor mean, error variances, factor variances, covariance and path
_FM = {f: "(" + " + ".join(cols) + f") / {len(cols)}.0::DOUBLE" for f, cols in FACTORS.items()}
PTAB = ITEMS + ", fm as (select *, " + ", ".join(f'{e} as "{f}"' for f, e in _FM.items()) + " from items), ptab as (" + " union all ".join(
    [f"select segment, '{q}' as lval, '~' as op, '{f}' as rval, regr_slope({q}, \"{f}\") as estimate from fm group by segment" for f, cols in FACTORS.items() for q in cols]
    + [f"select segment, '{q}', '~~', '{q}', var_samp({q}) from fm group by segment" for q in ITEM_COLS]
    + [f"select segment, '{a}', '{op}', '{b}', {e} from fm group by segment" for a, op, b, e in (
        ("A", "~~", "A", 'var_samp("A")'), ("B", "~~", "B", 'var_samp("B")'), ("A", "~~", "B", 'covar_samp("A", "B")'), ("B", "~", "A", 'regr_slope("B", "A")'))]) + ")"


def param_table(t):
    from ..operators.encode import factor_score_mean
    fm = items(t).withColumns({f: factor_score_mean(cols) for f, cols in FACTORS.items()})
    where = {q: f for f, cols in FACTORS.items() for q in cols}
    every = [*ITEM_COLS, "A", "B"]
    wide = fm.groupBy("segment").agg(*[F.var_samp(c).alias(f"v_{c}") for c in every], *[F.covar_samp(q, f).alias(f"c_{q}") for q, f in where.items()], F.covar_samp("A", "B").alias("c_AB"))
    row = lambda l, op, r, e: {"lval": F.lit(l), "op": F.lit(op), "rval": F.lit(r), "estimate": e}
    rows = [row(q, "~", f, F.col(f"c_{q}") / F.col(f"v_{f}")) for q, f in where.items()] + [row(c, "~~", c, F.col(f"v_{c}")) for c in every]
    rows += [row("A", "~~", "B", F.col("c_AB")), row("B", "~", "A", F.col("c_AB") / F.col("v_A"))]
    return stats.inline(wide, ["segment"], rows).withColumn("section", F.lit("Parameters"))


@query("sem_params", doubles="estimate", sql=f"""with {PTAB} select segment, lval, op, rval, estimate, case when op = '~' and lval like 'q%' then 'loading' when op = '~' then 'path' when lval like 'q%' then 'error'
  when lval = rval then 'variance' else 'covariance' end as part from ptab""")
def _(t):
    return latent.sem_params(param_table(t), ITEM_COLS).drop("section")


@query("sem_fit_params")
def _(t):
    return latent.sem_params(_sem(t), ITEM_COLS).select("segment", "part", "lval", "op", "rval", "estimate", "std_err")


@query("fit_indices")
def _(t):
    return latent.fit_indices(latent.multi_factor_fit(items(t), FACTORS, ["segment"]), ["segment"])


@query("factor_corr_model", doubles="r", sql=f"""with {ITEMS}, fm as (select segment, {_FM['A']} as a, {_FM['B']} as b from items), c as (select segment, corr(a, b) as r from fm group by segment)
  select segment, 'A' as var1, 'B' as var2, r from c union all select segment, 'B', 'A', r from c""")
def _(t):
    latent_rows = latent.sem_params(param_table(t), ITEM_COLS).filter("part in ('variance', 'covariance')").withColumn("p_value", F.lit(None).cast("double"))
    return latent.factor_corr_model(latent_rows, ["segment"]).drop("p_value")


@query("factor_corr_fit")
def _(t):
    params = latent.sem_params(latent.multi_factor_fit(items(t), FACTORS, ["segment"]), ITEM_COLS).filter("part in ('variance', 'covariance')")
    return latent.factor_corr_model(params, ["segment"])


@query("all_paths_regression")
def _(t):
    return latent.all_paths_regression(complete_scores(t), NODES)


_SDS = PATHS + ", sds as (" + " union all ".join(f"select segment as model, '{v}' as variable, stddev_samp({v}) as sd from complete group by segment" for v in NODES) + ")"


@query("standardize_params", doubles="standardized", sql=f"""with {_SDS} select p.model, lval, rval, estimate * r.sd / l.sd as standardized from paths p join sds l on l.model = p.model and l.variable = lval join sds r on r.model = p.model and r.variable = rval""")
def _(t):
    sds = stats.long_agg(complete_scores(t).withColumnRenamed("segment", "model"), NODES, {"sd": F.stddev_samp}, ["model"], "variable")
    return latent.standardize_params(paths(t).withColumn("op", F.lit("~")), sds, ["model"]).select("model", "lval", "rval", "standardized")


_EDGES = {"simple": [("m1", "x"), ("y", "m1"), ("y", "x")], "multiple": [("m1", "x"), ("m2", "x"), ("y", "m1"), ("y", "m2"), ("y", "x")],
          "serial": [("m1", "x"), ("m2", "x"), ("m2", "m1"), ("y", "m1"), ("y", "m2"), ("y", "x")],
          "saturated": [(a, b) for a in ("x", "m1", "m2", "y") for b in ("x", "m1", "m2", "y") if a != b]}


@query("path_models", sql="with roles as (select distinct p_brand as model, p_type as x, 'm_' || p_brand as m1, 'n_' || p_brand as m2, 'y_' || p_type as y from part) " + " union all ".join(
    f"select model, '{k}' as kind, {to} as to_var, {frm} as from_var from roles" for k, edges in _EDGES.items() for to, frm in edges))
def _(t):
    roles = t.part.select(F.col("p_brand").alias("model"), F.col("p_type").alias("x"), F.concat(F.lit("m_"), "p_brand").alias("m1"),
                          F.concat(F.lit("n_"), "p_brand").alias("m2"), F.concat(F.lit("y_"), "p_type").alias("y")).distinct()
    return latent.path_models(roles)


# observed covariances per segment against those implied by uncorrelated factor scores scaled by the whole sample
_CP = [(a, b) for i, a in enumerate(NODES) for b in NODES[i:]]
_RESID = COMPLETE + ", obs as (" + " union all ".join(f"select segment as model, '{a}' as var1, '{b}' as var2, covar_samp({a}, {b}) as observed from complete group by segment" for a, b in _CP) + "), imp as (" + " union all ".join(
    f"select '{a}' as var1, '{b}' as var2, covar_samp({a}, {b}) as implied from complete" for a, b in _CP) + "), res as (select model, obs.var1, obs.var2, observed, implied, observed - implied as residual from obs join imp on obs.var1 = imp.var1 and obs.var2 = imp.var2)"


def _residuals(t):
    c = complete_scores(t).withColumnRenamed("segment", "model")
    obs = stats.cov_sufficient_stats(c, NODES, ["model"])
    imp = stats.cov_sufficient_stats(c, NODES).select("var1", "var2", "cov")
    return latent.residual_cov(obs, imp, ["model"])


@query("residual_cov", doubles="observed implied residual", sql=f"with {_RESID} select * from res")
def _(t):
    return _residuals(t)


@query("modification_index", doubles="residual mi expected_change", sql=f"""with {_RESID}, sizes as (select segment as model, count(*)::DOUBLE as n from complete group by segment), sym as (select model, var1 as from_var, var2 as to_var, residual from res where var1 <> var2 union all select model, var2, var1, residual from res where var1 <> var2),
  va as (select model, var1 as v, observed from res where var1 = var2)
  select s.model, s.from_var, s.to_var, residual, n * residual * residual / b.observed as mi, residual / a.observed as expected_change, n * residual * residual / b.observed >= 3.84 as recommended
  from sym s join va a on a.model = s.model and a.v = from_var join va b on b.model = s.model and b.v = to_var join sizes on sizes.model = s.model""")
def _(t):
    r = _residuals(t)
    var = r.filter("var1 = var2").select("model", F.col("var1").alias("variable"), F.col("observed").alias("variance"))
    from ..operators.shape import ordered_pairs
    sizes = complete_scores(t).groupBy(F.col("segment").alias("model")).agg(F.count("*").alias("n"))
    pairs = ordered_pairs(nodes(t), ["model"], "node").join(sizes, "model")
    return latent.modification_index(r, var, pairs, "n", ["model"]).drop("p_value", "n")


@query("compare_stage2_bootstrap", doubles="estimate bootstrap_mean difference percent", sql=f"""with {WEIGHTS}, per as (select o_custkey as id, sum(o_totalprice) as s, count(*) as c from orders group by 1),
  r as (select replicate, sum(w * s) / sum(w * c) as value from weights join per on weights.id = per.id group by replicate),
  j as (select (select avg(o_totalprice) from orders) as estimate, avg(value) as bootstrap_mean from r)
  select 'o_totalprice' as parameter, estimate, bootstrap_mean, bootstrap_mean - estimate as difference, 100 * (bootstrap_mean - estimate) / abs(estimate) as percent, sign(estimate) * sign(bootstrap_mean) < 0 as sign_differs from j""")
def _(t):
    reps = resample.weighted_means(t.orders.select(F.col("o_custkey").alias("id"), "o_totalprice"), weights(t), "id", ["o_totalprice"])
    est = t.orders.agg(F.avg("o_totalprice").alias("v")).select(F.lit("o_totalprice").alias("parameter"), "v")
    return compare_estimates(est, reps.groupBy("parameter").agg(F.avg("value").alias("v")), ["parameter"], "v", ("estimate", "bootstrap_mean"))


