"""Reshaping, joins, comparisons and grids on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import to_long
from ..operators import checks, encode, shape, stats
from .bindings import (COMPLETE, FACTORS, ITEM_COLS, LOADINGS, LONG, PATHS, RAW, REVERSED, RUNS, SCORES, choice_long,
                       complete_scores, items, nodes, paths, raw_items, runs, scores)
from .registry import query

# questionnaire: one choice set per brand, one alternative per part type, priced at the mean of its parts
_SETS = range(1, 26)
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_ANSWERS = {f"a{s}": s for s in _SETS}
WIDE = "wide as (select c_custkey as id, " + ", ".join(f"cast(c_custkey // {s} % 6 + 1 as bigint) as a{s}" for s in _SETS) + " from customer)"
DESIGN = f"""design as (select cast(replace(p_brand, 'Brand#', '') as bigint) as sid, cast(list_position({_TYPES!r}, p_type) as bigint) as alt,
  avg(p_retailprice) as price from part group by all)"""


def wide_answers(t):
    return t.customer.selectExpr("c_custkey as id", *[f"cast((c_custkey div {s}) % 6 + 1 as bigint) as a{s}" for s in _SETS])


def design(t):
    return t.part.groupBy(F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("bigint").alias("sid"),
                          F.array_position(F.array(*[F.lit(x) for x in _TYPES]), F.col("p_type")).alias("alt")
                          ).agg(F.avg("p_retailprice").alias("price"))


@query("wide_to_long_choice", doubles="price:4", sql=f"""with {WIDE}, {DESIGN}, a as ({' union all '.join(f"select id, {s} as sid, a{s} as answer from wide" for s in _SETS)})
  select id, design.sid, alt, price, cast(case when alt = answer then 1 else 0 end as integer) as chosen from a join design on a.sid = design.sid""")
def _(t):
    return shape.wide_to_long_choice(wide_answers(t), "id", _ANSWERS, design(t))


@query("answer_distribution_diff", sql=f"""with {WIDE}, {DESIGN}, a as ({' union all '.join(f"select id, cast({s} as bigint) as sid, a{s} as alt from wide" for s in _SETS)}),
  s as (select sid, alt, cast(count(*) as bigint) as n from a group by all),
  l as (select a.sid, a.alt, cast(count(*) as bigint) as n from a join design on a.sid = design.sid and a.alt = design.alt group by all)
  select sid, alt, coalesce(s.n, 0) as n_source, coalesce(l.n, 0) as n_long, coalesce(s.n, 0) = coalesce(l.n, 0) as matches from s full join l using (sid, alt)""")
def _(t):
    wide = wide_answers(t)
    return checks.answer_distribution_diff(wide, _ANSWERS, shape.wide_to_long_choice(wide, "id", _ANSWERS, design(t)), "sid", "alt", "chosen")


@query("merge_factors_inner", doubles="score_a score_b", sql=f"""with {SCORES} select a.id, a.sa as score_a, b.sb as score_b, sc is null as no_spend
  from scores a join (select id, sb from scores) b on a.id = b.id""")
def _(t):
    s = scores(t)
    tables = {"a": s.select("id", F.col("sa").alias("score"), F.col("sc").isNull().alias("no_spend")), "b": s.select("id", F.col("sb").alias("score"))}
    return shape.merge_factors_inner(tables, "id")


@query("common_ids", doubles="balance:2", sql="""select c_custkey as id, c_acctbal as balance from customer
  where c_custkey in (select user_id from events) and c_custkey in (select s_suppkey from supplier)""")
def _(t):
    both = shape.common_ids([t.customer.select(F.col("c_custkey").alias("id")), t.events.select(F.col("user_id").alias("id")),
                             t.supplier.select(F.col("s_suppkey").alias("id"))], "id")
    return shape.restrict_to(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), both, "id")


@query("intersect_ids", sql="select c_custkey as id from customer intersect select user_id from events")
def _(t):
    return shape.common_ids([t.customer.select(F.col("c_custkey").alias("id")), t.events.select(F.col("user_id").alias("id"))], "id")


@query("except_ids", sql="select c_custkey as id from customer except select user_id from events")
def _(t):
    return shape.except_ids(t.customer.select(F.col("c_custkey").alias("id")), t.events.select(F.col("user_id").alias("id")), "id")


@query("integrate_left", doubles="sa sb sc price:2", sql=f"""with {LONG}, {SCORES}
  select long.id, sid, alt, chosen, price, sa, sb, sc, segment from long left join scores on long.id = scores.id""")
def _(t):
    s = scores(t)
    return shape.integrate_left(choice_long(t).select("id", "sid", "alt", "chosen", "price"),
                                [s.select("id", "sa"), s.select("id", "sb", "sc"), t.customer.selectExpr("c_custkey as id", "c_mktsegment as segment")], "id")


@query("attach_scores", doubles="sa sb", sql=f"with {LONG}, {SCORES} select sid, alt, chosen, sa, sb from long left join scores on long.id = scores.id")
def _(t):
    return shape.attach_scores(choice_long(t), scores(t), "id", ["sa", "sb"]).select("sid", "alt", "chosen", "sa", "sb")


@query("assert_row_preserving", sql="""with l as (select user_id as id, count(*) as l from events group by 1), r as (select o_custkey as id, count(*) as r from orders group by 1)
  select cast(sum(l) as bigint) as n_left, cast(sum(l * coalesce(r, 1)) as bigint) as n_joined, cast(count(*) filter (where r > 1) as bigint) as right_duplicates,
    cast(count(*) filter (where r is null) as bigint) as ids_without_match, sum(l) = sum(l * coalesce(r, 1)) as preserved from l left join r using (id)""")
def _(t):
    return checks.assert_row_preserving(t.events.select(F.col("user_id").alias("id")), t.orders.select(F.col("o_custkey").alias("id")), "id")


@query("integrate_how", doubles="value_dce:2 value_sem:2", sql="""select coalesce(user_id, c_custkey) as id, event_id, value as value_dce, c_acctbal as value_sem
  from events full join customer on user_id = c_custkey""")
def _(t):
    return shape.integrate_how(t.events.select(F.col("user_id").alias("id"), "event_id", "value"),
                               t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")), "id", "outer")


@query("integrate_summary", doubles="merge_ratio", sql="""select how, (select count(*) from events) as left_size, (select count(*) from orders) as right_size, n as merged_size, k as merged_ids,
    n / greatest((select count(*) from events), (select count(*) from orders))::DOUBLE as merge_ratio from (
  select 'inner' as how, count(*) as n, count(distinct user_id) as k from events join orders on user_id = o_custkey
  union all select 'left', count(*), count(distinct user_id) from events left join orders on user_id = o_custkey
  union all select 'outer', count(*), count(distinct coalesce(user_id, o_custkey)) from events full join orders on user_id = o_custkey)""")
def _(t):
    left, right = t.events.select(F.col("user_id").alias("id")), t.orders.select(F.col("o_custkey").alias("id"))
    return shape.stack_paths({how: shape.integrate_summary(left, right, "id", how) for how in ("inner", "left", "outer")}, "how")


@query("id_compatibility", sql="""with a as (select distinct c_custkey as id, 1 as l from customer), b as (select distinct user_id as id, 1 as r from events)
  select cast(count(*) filter (where l = 1 and r = 1) as bigint) as common_ids, cast(count(*) filter (where r is null) as bigint) as left_only,
    cast(count(*) filter (where l is null) as bigint) as right_only, count(l) as left_ids, count(r) as right_ids from a full join b using (id)""")
def _(t):
    return shape.id_compatibility(t.customer.select(F.col("c_custkey").alias("id")), t.events.select(F.col("user_id").alias("id")), "id")


@query("crosstab", sql="""select l_returnflag, cast(count(*) filter (where l_linestatus = 'F') as bigint) as "F", cast(count(*) filter (where l_linestatus = 'O') as bigint) as "O"
  from lineitem group by 1""")
def _(t):
    return shape.crosstab(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


_RAW_LOAD = " union all ".join(f"select '{f}' as factor, '{q}' as item, corr({q}, {' + '.join(c)}) as loading from raw" for f, c in FACTORS.items() for q in c)
_FIX_LOAD = " union all ".join("select '{}' as factor, '{}' as item, corr({}, {}) as loading from raw".format(
    f, q, f"6 - {q}" if q in REVERSED else q, " + ".join(f"(6 - {i})" if i in REVERSED else i for i in c)) for f, c in FACTORS.items() for q in c)


@query("compare_loadings", doubles="before after change abs_change", sql=f"""with {RAW}, b as ({_RAW_LOAD}), a as ({_FIX_LOAD})
  select b.item, b.factor, b.loading as before, a.loading as after, a.loading - b.loading as change, abs(a.loading - b.loading) as abs_change,
    a.loading * b.loading < 0 as sign_changed, abs(b.loading) >= 0.5 as before_acceptable, abs(a.loading) >= 0.5 as after_acceptable, abs(a.loading) > abs(b.loading) as improved
  from a join b on a.item = b.item""")
def _(t):
    raw = raw_items(t)
    return shape.compare_loadings(stats.item_total_loadings(raw, FACTORS), stats.item_total_loadings(encode.reverse_code(raw, REVERSED), FACTORS))


_FIT = """select segment, 'CFI' as metric, avg({s}) / 5 as value from complete group by segment
  union all select segment, 'RMSEA', stddev_samp({s}) / 10 from complete group by segment
  union all select segment, 'other', avg({s}) - 3 from complete group by segment"""


def _fit(t, s):
    g = complete_scores(t).groupBy("segment").agg(F.avg(s).alias("m"), F.stddev_samp(s).alias("d"))
    rows = [("CFI", F.col("m") / 5), ("RMSEA", F.col("d") / 10), ("other", F.col("m") - 3)]
    return stats.inline(g, ["segment"], [{"metric": F.lit(n), "value": v} for n, v in rows])


@query("compare_fit", doubles="before after change percent_change:8", sql=f"""with {COMPLETE}, b as ({_FIT.format(s='sa')}), a as ({_FIT.format(s='sb')})
  select b.segment, b.metric, b.value as before, a.value as after, a.value - b.value as change, (a.value - b.value) / abs(b.value) * 100 as percent_change,
    case b.metric when 'CFI' then a.value > b.value when 'RMSEA' then a.value < b.value else abs(a.value) < abs(b.value) end as improved
  from a join b on a.segment = b.segment and a.metric = b.metric""")
def _(t):
    return shape.compare_fit(_fit(t, "sa"), _fit(t, "sb"), ["segment", "metric"])


@query("compare_estimates", doubles="before:13 after:13 difference:13 percent:4", sql=f"""with {RUNS}, a as (select run, parameter, estimate from runs where parameter <> 'SMALL'),
  b as (select run, parameter, std_error from runs where parameter <> 'LARGE')
  select run, parameter, estimate as before, std_error as after, std_error - estimate as difference, 100 * (std_error - estimate) / nullif(abs(estimate), 0) as percent,
    sign(estimate) * sign(std_error) < 0 as sign_differs from a full join b using (run, parameter)""")
def _(t):
    r = runs(t)
    return shape.compare_estimates(r.filter("parameter <> 'SMALL'").select("run", "parameter", F.col("estimate").alias("v")),
                                   r.filter("parameter <> 'LARGE'").select("run", "parameter", F.col("std_error").alias("v")),
                                   ["run", "parameter"], "v", ("before", "after"))


@query("pair_models", doubles="first second difference", sql="""with m as (select l_returnflag as structure, l_linenumber as model, avg(l_extendedprice) as aic from lineitem group by all)
  select a.model, a.aic as first, b.aic as second, a.aic - b.aic as difference from m a join m b on a.model = b.model where a.structure = 'A' and b.structure = 'N'""")
def _(t):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("structure"), F.col("l_linenumber").alias("model")).agg(F.avg("l_extendedprice").alias("aic"))
    return shape.pair_models(m, "structure", "A", "N", ["model"], "aic")


_WANTED = [("sa", "sb"), ("sb", "sc"), ("sa", "none")]


@query("path_exists", doubles="estimate", sql=f"""with {PATHS}, asked as (select distinct model, f as from_var, g as to_var from paths, (values {', '.join(map(str, _WANTED))}) w(f, g))
  select asked.model, from_var, to_var, estimate is not null as found, coalesce(estimate, 0) as estimate from asked left join paths on asked.model = paths.model and from_var = rval and to_var = lval""")
def _(t):
    p = paths(t)
    pairs = p.select("model").distinct().select("model", F.explode(F.array(*[F.struct(F.lit(a).alias("from_var"), F.lit(b).alias("to_var")) for a, b in _WANTED])).alias("w"))
    return shape.path_exists(pairs.select("model", "w.*"), p, ["model"])


@query("missing_paths", sql=f"""with {PATHS}, n as (select distinct model, lval as node from paths), strong as (select * from paths where abs(estimate) > 2 * std_err)
  select a.model, a.node as from_var, b.node as to_var from n a join n b on a.model = b.model and a.node <> b.node
  where (a.model, a.node, b.node) not in (select (model, rval, lval) from strong)""".replace("(a.model, a.node, b.node) not in (select (model, rval, lval) from strong)",
                                                                                              "not exists (select 1 from strong s where s.model = a.model and s.rval = a.node and s.lval = b.node)"))
def _(t):
    return shape.missing_paths(nodes(t), paths(t).filter(F.abs("estimate") > 2 * F.col("std_err")), ["model"], "node")


@query("stack_paths", doubles="estimate", sql=f"with {PATHS} select model, rval, estimate, lval as target from paths where lval in ('sb', 'sc')")
def _(t):
    p = paths(t).select("model", "lval", "rval", "estimate")
    return shape.stack_paths({v: p.filter(F.col("lval") == v).drop("lval") for v in ("sb", "sc")})


@query("union_by_name", doubles="v:2", sql="""select c_custkey as id, c_acctbal as v, c_mktsegment as segment, 'customer' as source from customer
  union all select s_suppkey, s_acctbal, null, 'supplier' from supplier""")
def _(t):
    return shape.stack_paths({"customer": t.customer.selectExpr("c_custkey as id", "c_acctbal as v", "c_mktsegment as segment"),
                              "supplier": t.supplier.selectExpr("s_suppkey as id", "s_acctbal as v")}, "source")


@query("pair_enumeration", sql="""with n as (select distinct p_brand as model, p_type as node from part)
  select a.model, a.node as x, b.node as m, c.node as y from n a join n b on a.model = b.model and a.node <> b.node join n c on a.model = c.model and c.node <> a.node and c.node <> b.node""")
def _(t):
    return shape.pair_enumeration(t.part.select(F.col("p_brand").alias("model"), F.col("p_type").alias("node")).distinct(), ["model"], "node")


@query("model_grid", sql="""with base as (select distinct p_type from part),
  g as (select p_type, cast(m.range as integer) as main_mask, cast(i.range as integer) as inter_mask from base, range(8) m, range(64) i)
  select p_type, main_mask, inter_mask,
    concat_ws(',', case when main_mask & 1 > 0 then 'PI' end, case when main_mask & 2 > 0 then 'NK' end, case when main_mask & 4 > 0 then 'PP' end) as main_lvs,
    concat_ws(',', case when inter_mask & 1 > 0 then 'PI:hl' end, case when inter_mask & 2 > 0 then 'PI:pr' end, case when inter_mask & 4 > 0 then 'NK:hl' end,
      case when inter_mask & 8 > 0 then 'NK:pr' end, case when inter_mask & 16 > 0 then 'PP:hl' end, case when inter_mask & 32 > 0 then 'PP:pr' end) as interactions
  from g where (inter_mask & 3 = 0 or main_mask & 1 > 0) and (inter_mask & 12 = 0 or main_mask & 2 > 0) and (inter_mask & 48 = 0 or main_mask & 4 > 0)""")
def _(t):
    return shape.model_grid(t.part.select("p_type").distinct(), ["PI", "NK", "PP"], ["hl", "pr"])


@query("scenario_grid", doubles="sa sb prob", sql=f"""with {SCORES} select id, -1 + i.range * 0.5::DOUBLE as sa, -1 + j.range * 0.5::DOUBLE as sb,
    1 / (1 + exp(-(0.2 + 0.5 * (-1 + i.range * 0.5::DOUBLE) - 0.3 * (-1 + j.range * 0.5::DOUBLE) + 0.1 * coalesce(sc, 0)))) as prob from scores, range(5) i, range(5) j""")
def _(t):
    g = shape.scenario_grid(scores(t).select("id", "sc"), {"sa": (-1, 1, 5), "sb": (-1, 1, 5)})
    v = 0.2 + 0.5 * F.col("sa") - 0.3 * F.col("sb") + 0.1 * F.coalesce("sc", F.lit(0.0))
    return g.select("id", "sa", "sb", (1 / (1 + F.exp(-v))).alias("prob"))


@query("sort_rows", sql=f"with {LONG} select id, sid, alt, chosen from long order by id, sid, alt")
def _(t):
    return choice_long(t).select("id", "sid", "alt", "chosen").orderBy("id", "sid", "alt")


@query("top_k", doubles="l_extendedprice:2", sql="""select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
  order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 20""")
def _(t):
    return shape.top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
                       ["-l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], 20)


@query("factor_score_loading", doubles="score", sql=f"""with {LOADINGS}, long_items as ({' union all '.join(f"select id, '{f}' as factor, '{q}' as item, {q} as value from items" for f, c in FACTORS.items() for q in c)})
  select id, long_items.factor, sum(loading * value) / sum(loading * loading) as score from long_items join loadings on long_items.item = loadings.item group by id, long_items.factor""")
def _(t):
    it = items(t)
    where = F.create_map(*[F.lit(x) for f, c in FACTORS.items() for q in c for x in (q, f)])
    long = to_long(it, ["id"], ITEM_COLS, "item", "value").withColumn("factor", where[F.col("item")])
    return stats.factor_score_loading(long, stats.item_total_loadings(it, FACTORS), "id")
