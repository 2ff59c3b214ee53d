"""Sources, checks and encodings on the driver tables."""

from __future__ import annotations


import warnings

from pyspark.sql import functions as F

from ..operators import checks, encode
from ..session import fresh_path
from ..sources import logs, runs as run_source, tables
from .bindings import (FACTORS, ITEM_COLS, ITEMS, LONG, OPT, RAW, REVERSED, RUNS, SCORES, choice_long, items,
                       raw_items, runs, scores, with_opt_out)
from .registry import query

# ---- sources ---------------------------------------------------------------------------------------------


@query("read_responses", doubles="c_acctbal:2", sql="select c_custkey, c_nationkey, c_acctbal from customer")
def _(t):
    return tables.read_responses(t.spark, t.file("customer"),
                                 {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}, "parquet")


@query("read_factor_tables", doubles="value:2", sql="""
  select c_custkey as id, 'balance' as factor, 'c_acctbal' as item, c_acctbal as value from customer
  union all select s_suppkey, 'supply', 's_acctbal', s_acctbal from supplier
  union all select s_suppkey, 'supply', 's_nationkey', cast(s_nationkey as double) from supplier""")
def _(t):
    specs = {"balance": (t.file("customer"), "c_custkey", ["c_acctbal"]),
             "supply": (t.file("supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]),
             "absent": (t.file("no_such_table"), "id", ["x"])}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return tables.read_factor_tables(t.spark, specs, "parquet")


@query("split_factor_tables", doubles="value:2", sql="""
  with firsts as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1)
  select o_custkey as id, 'spend' as factor, 'o_totalprice' as item, o_totalprice as value from firsts
  union all select o_custkey, 'key', 'o_orderkey', cast(o_orderkey as double) from firsts""")
def _(t):
    return tables.split_factor_tables(t.orders, "o_custkey", ["o_orderkey"],
                                      {"spend": ["o_totalprice"], "key": ["o_orderkey"]})


@query("read_design", doubles="p_retailprice:2",
       sql="select cast(p_size as bigint) as sid, p_partkey as alt, p_brand, p_type, p_retailprice from part")
def _(t):
    return tables.read_design(t.spark, t.file("part"), "p_size", "p_partkey",
                              {"p_brand": "string", "p_type": "string", "p_retailprice": "double"}, "parquet")


@query("explode_json_map", sql="""
  select event_id, k as key, cast(json_extract(props, '$.' || k) as integer) as value
  from (select event_id, props, unnest(json_keys(props)) as k from events)""")
def _(t):
    return tables.explode_json_map(t.events, ["event_id"], "props")


@query("read_item_metadata", sql="""with i as (select distinct p_brand as factor, p_type || ' ' || p_size as item, p_size from part)
  select factor, item, cast(row_number() over (partition by factor order by item) - 1 as integer) as position, p_size % 3 = 0 as is_reversed, 1 as scale_min, 5 as scale_max from i""")
def _(t):
    """A metadata file is written from the parts and read back."""
    items = t.part.select(F.col("p_brand").alias("factor"), F.concat_ws(" ", "p_type", "p_size").alias("item"), "p_size").distinct()
    per = items.groupBy("factor").agg(F.struct(F.sort_array(F.collect_list("item")).alias("items"),
                                               F.sort_array(F.collect_list(F.when(F.col("p_size") % 3 == 0, F.col("item")))).alias("reverse_items")).alias("m"))
    meta = per.agg(F.map_from_entries(F.collect_list(F.struct("factor", "m"))).alias("reverse_items"))
    text = meta.select(F.to_json(F.struct("reverse_items", F.struct(F.lit(1).alias("min"), F.lit(5).alias("max")).alias("scale_range"))).alias("value"))
    return tables.read_item_metadata(t.spark, written(text, "metadata"))


def written(text, name: str) -> str:
    """A text column as files in the shared folder."""
    path = fresh_path(text.sparkSession, name)
    text.write.text(path)
    return path


@query("read_result_runs", doubles="estimate:7 std_error:7", sql=f"""with {RUNS}
  select run, parameter, estimate, case when run < 'Brand#3' then std_error end as std_error, run < 'Brand#3' as wide from runs""")
def _(t):
    """Result files with two different headers, one without standard errors, are written and read back together."""
    rows = runs(t).select(F.col("run").alias("model"), "parameter", "estimate", "std_error")
    paths = []
    for name, part in (("wide", rows.filter("model < 'Brand#3'")), ("narrow", rows.filter("model >= 'Brand#3'").drop("std_error"))):
        paths.append(fresh_path(t.spark, name))
        part.repartition("parameter").write.option("header", True).csv(paths[-1])
    df = run_source.read_result_runs(t.spark, paths)
    return df.select(F.col("model").alias("run"), "parameter", F.col("estimate").cast("double"), F.col("std_error").cast("double"),
                     F.col("std_error").isNotNull().alias("wide"))


@query("read_result_tables", doubles="total:2", sql="""
  select 'supplier.parquet' as run_file, 'supplier' as run, cast(count(*) as bigint) as n, sum(s_acctbal) as total from supplier""")
def _(t):
    df = run_source.read_result_runs(t.spark, t.file("supplier"), "parquet")
    return df.groupBy("run_file", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("total"))


# run names built from part rows: two or three paths, main effects and interactions by part attributes
_NAME_SQL = """names as (select p_partkey as part,
    case when p_size > 25 then 'HC-PB_PB-PI' else 'HC-PB_HC-PP_PB-PI' end as s1,
    case when p_type in ('ECONOMY', 'SMALL') then 'NK_PI' when p_type = 'PROMO' then 'PI' else 'base' end as s2,
    case when p_retailprice > 1200 and p_type in ('ECONOMY', 'SMALL') then '_int_PIxhl_NKxpr' else '' end as s3
  from part), named as (select part, 'st2_' || s1 || '1_' || s2 || s3 || '2_results.csv' as run, s1, s2, s3 from names)"""


def run_names(t):
    long_path = F.when(F.col("p_size") > 25, F.array(F.lit("HC-PB"), F.lit("PB-PI"))).otherwise(
        F.array(F.lit("HC-PB"), F.lit("HC-PP"), F.lit("PB-PI")))
    pair = F.col("p_type").isin("ECONOMY", "SMALL")
    main = (F.when(pair, F.array(F.lit("NK"), F.lit("PI"))).when(F.col("p_type") == "PROMO", F.array(F.lit("PI")))
            .otherwise(F.array().cast("array<string>")))
    inter = F.when(pair & (F.col("p_retailprice") > 1200), F.array(F.lit("PIxhl"), F.lit("NKxpr"))).otherwise(
        F.array().cast("array<string>"))
    return t.part.select(F.col("p_partkey").alias("part"), run_source.run_name(long_path, main, inter).alias("run"))


@query("parse_run_name", sql=f"""with {_NAME_SQL} select part, run,
    case when s1 = 'HC-PB_PB-PI' then 'HC->PB,PB->PI' else 'HC->PB,HC->PP,PB->PI' end as paths,
    case s2 when 'NK_PI' then 'nutrition_knowledge,purchase_intention' when 'PI' then 'purchase_intention' else '' end as main_lvs,
    case when s3 <> '' then 'nutrition_knowledge:price,purchase_intention:health_label' else '' end as interactions
  from named""")
def _(t):
    parsed = run_source.parse_run_name(run_names(t), "run")
    return parsed.select("part", "run", *[F.array_join(c, ",").alias(c) for c in ("paths", "main_lvs", "interactions")])


# parameters of a run: theta_ by segment of the part type, gamma_ only for expensive parts
_PARAM_SQL = """params as (
  select p_brand as run, 'theta_sugar_' || case when p_size > 25 then 'purchase_intention' else 'nutrition_knowledge' end as parameter from part
  union all select p_brand, 'gamma_sugar_free_purchase_intention_' || case when p_type = 'PROMO' then 'price' else 'health_label' end
    from part where p_retailprice > 1000
  union all select p_brand, 'beta_price' from part)"""


def run_params(t):
    p = t.part
    theta = p.select(F.col("p_brand").alias("run"), F.concat(F.lit("theta_sugar_"), F.when(
        F.col("p_size") > 25, "purchase_intention").otherwise("nutrition_knowledge")).alias("parameter"))
    gamma = p.filter("p_retailprice > 1000").select(F.col("p_brand").alias("run"), F.concat(
        F.lit("gamma_sugar_free_purchase_intention_"),
        F.when(F.col("p_type") == "PROMO", "price").otherwise("health_label")).alias("parameter"))
    return theta.unionByName(gamma).unionByName(p.select(F.col("p_brand").alias("run"), F.lit("beta_price").alias("parameter")))


_PARSED_PARAMS = _PARAM_SQL + """, split as (select distinct run,
    case when parameter like 'theta_%' then replace(parameter, 'theta_sugar_', '') end as lv,
    case when parameter like 'gamma_%' then 'purchase_intention:' || replace(parameter, 'gamma_sugar_free_purchase_intention_', '') end as pair
  from params), parsed as (select run, coalesce(string_agg(distinct lv, ',' order by lv), '') as main_lvs,
    coalesce(string_agg(distinct pair, ',' order by pair), '') as interactions from split group by run)"""


@query("parse_run_params", sql=f"with {_PARSED_PARAMS} select run, main_lvs, interactions from parsed")
def _(t):
    out = run_source.parse_run_params(run_params(t), "run", "parameter")
    return out.select("run", *[F.array_join(c, ",").alias(c) for c in ("main_lvs", "interactions")])


@query("check_run_consistency", sql=f"""with {_PARAM_SQL}, found as (
    select distinct run,
      case when parameter like 'theta_%' then replace(parameter, 'theta_sugar_', '') end as lv,
      case when parameter like 'gamma_%' then 'purchase_intention:' || replace(parameter, 'gamma_sugar_free_purchase_intention_', '') end as pair
    from params),
  told as (select distinct p_brand as run from part),
  c as (select told.run,
    'purchase_intention' as main, 'purchase_intention:price' as inter,
    coalesce(bool_or(lv = 'purchase_intention'), false) as has_pi,
    coalesce(bool_or(pair = 'purchase_intention:price'), false) as has_price,
    coalesce(string_agg(distinct lv, ',' order by lv) filter (where lv <> 'purchase_intention'), '') as extra_main,
    coalesce(string_agg(distinct pair, ',' order by pair) filter (where pair <> 'purchase_intention:price'), '') as extra_inter
    from told left join found on told.run = found.run group by told.run)
  select run, case when has_pi then '' else main end as only_name_main, extra_main as only_file_main,
    case when has_price then '' else inter end as only_name_inter, extra_inter as only_file_inter,
    has_pi and has_price and extra_main = '' and extra_inter = '' as consistent from c""")
def _(t):
    told = t.part.select(F.col("p_brand").alias("brand")).distinct().select(
        "brand", F.lit("st2_HC-PB_PB-PI1_PI_int_PIxpr2_results.csv").alias("run_file"))
    names = run_source.parse_run_name(told, "run_file").withColumnRenamed("brand", "run")
    return run_source.check_run_consistency(names, run_source.parse_run_params(run_params(t), "run", "parameter"), "run")


# one log block per event, two blocks per text where the event is followed by its own retry
_STATUS = "case event_type when 'error' then 'FAIL' when 'click' then 'WARN' else 'OK' end"


def event_logs(t):
    text = F.format_string(
        "noise\n[Major Iteration #%d 완료]\n  최종 LL: %s\n  Line Search: %d회 함수 호출 - [%s]\n"
        "  함수 호출: %d회 (누적)\n  그래디언트 호출: %d회 (누적)\n  ftol = %s\n  gtol = %s\n",
        F.col("event_id"), (-F.col("value")).cast("string"), F.col("user_id"), F.expr(_STATUS),
        F.col("event_id") * 2, F.col("event_id") + 1,
        F.when(F.col("event_type") == "view", "N/A").otherwise("1e-3"), (F.col("value") / 1024).cast("string"))
    return t.events.select(F.col("event_id").alias("run"), F.concat(text, text).alias("text"))


@query("read_estimation_log", doubles="ll:4 ftol:6 gtol:6", sql=f"""
  select event_id as iteration, -value as ll, user_id as line_search_calls, {_STATUS} as status,
    event_id * 2 as func_calls, event_id + 1 as grad_calls,
    case when event_type <> 'view' then 0.001::DOUBLE end as ftol, value / 1024 as gtol
  from events, (values (1), (2)) as twice(k)""")
def _(t):
    """Log files are written, one block after the other, and read by their marks."""
    return logs.read_estimation_log(t.spark, written(event_logs(t).select("text"), "logs")).drop("run")


@query("read_param_trace", doubles="value:3 gradient:6", sql="""
  select event_id as run, cast(0 as bigint) as param_index, 'beta_' || event_type as parameter, round(value, 1) as value, 0.5::DOUBLE as gradient from events
  union all select event_id, 1, 'gamma_' || event_type, -round(value, 1), -0.25::DOUBLE from events""")
def _(t):
    """Every event's trace stands under its own iteration mark in the files, which tells the rows of one run from another's."""
    line = "  [%3d] %s : param=%.1fe+00, grad=%s\n"
    v = F.round("value", 1)
    text = F.concat(F.format_string(f"{logs.ITERATION_MARK}%d 완료]\nhead\n{logs.TRACE_MARK}\n", "event_id"),
                    F.format_string(line, F.lit(0), F.concat(F.lit("beta_"), "event_type"), v, F.lit("5.0e-01")),
                    F.format_string(line, F.lit(1), F.concat(F.lit("gamma_"), "event_type"), -v, F.lit("-2.5e-01")))
    rows = logs.read_param_trace(t.spark, written(t.events.select(text.alias("text")), "traces"), numbered=True)
    return rows.select(F.col("iteration").alias("run"), "param_index", "parameter", "value", "gradient")


@query("write_results", doubles="estimate:13 std_error:13", sql=f"""with {RUNS}
  select run, parameter, estimate, std_error, 'mean_discount' as analysis, '20250101_000000' as run_ts from runs""")
def _(t):
    path = fresh_path(t.spark, "results")
    run_source.write_results(runs(t).select("run", "parameter", "estimate", "std_error"), path, "mean_discount", "20250101_000000")
    return run_source.read_results(t.spark, path, "run string, parameter string, estimate double, std_error double",
                                   analysis="mean_discount")


@query("save_load_factor_scores", doubles="sa sb", sql=f"with {SCORES} select id, sa, sb from scores")
def _(t):
    path = fresh_path(t.spark, "scores")
    run_source.save_factor_scores(scores(t).select("id", "sa", "sb"), path)
    return run_source.load_factor_scores(t.spark, path, "id", ["sa", "sb"])




@query("latest_run", sql=f"""with {RUNS} select parameter as analysis, run, run_ts from runs
  qualify row_number() over (partition by parameter order by run_ts desc, run) = 1""")
def _(t):
    return run_source.latest_run(runs(t).select(F.col("parameter").alias("analysis"), "run", "run_ts"), "analysis", "run_ts", "run")


@query("runs_to_expire", sql=f"""with {RUNS} select parameter as analysis, run, run_ts from runs
  qualify row_number() over (partition by parameter order by run_ts desc, run) > 3""")
def _(t):
    return run_source.runs_to_expire(runs(t).select(F.col("parameter").alias("analysis"), "run", "run_ts"),
                                     "analysis", "run_ts", "run", 3)


@query("run_summary", sql=f"""with {RUNS} select parameter as analysis, cast(count(*) as bigint) as n_versions,
  max(run_ts) as latest, min(run_ts) as oldest from runs group by parameter""")
def _(t):
    return run_source.run_summary(runs(t).withColumnRenamed("parameter", "analysis"), "analysis", "run_ts")


# ---- validation and cleaning -----------------------------------------------------------------------------


@query("require_columns")
def _(t):
    df = t.lineitem
    checks.require_columns(df, ["l_orderkey", "l_linenumber"])
    try:
        checks.require_columns(df, ["l_orderkey", "no_such_column"])
        verdict = "none missing"
    except ValueError as e:
        verdict = str(e)
    return df.agg(F.count("l_orderkey").alias("n")).withColumn("verdict", F.lit(verdict))


@query("domain_check", sql=f"""with {RAW}, {LONG}
  select 'likert' as rule, cast(count(*) filter (where c_nationkey not between 1 and 5) as bigint) as n_bad from customer
  union all select 'binary', cast(count(*) filter (where c_nationkey not in (0, 1)) as bigint) from customer
  union all select 'positive', cast(count(*) filter (where c_acctbal <= 0) as bigint) from customer
  union all select 'min_rows', cast(case when count(*) < 100 then 1 else 0 end as bigint) from customer""")
def _(t):
    c = F.col
    return checks.domain_check(t.customer, {"likert": ~c("c_nationkey").between(1, 5), "binary": ~c("c_nationkey").isin(0, 1),
                                            "positive": c("c_acctbal") <= 0})


@query("missing_profile", doubles="share", sql="with " + RAW + " " + " union all ".join(
    f"select '{q}' as column_name, cast(count(*) - count({q}) as bigint) as n_missing, (count(*) - count({q})) / count(*)::DOUBLE as share from raw"
    for q in ITEM_COLS))
def _(t):
    return checks.missing_profile(raw_items(t), ITEM_COLS)


@query("stage_diff", doubles="before_value after_value", sql=f"with {RAW}, {ITEMS}, b as (" + " union all ".join(
    f"select id, '{q}' as item, cast({q} as double) as before_value from raw" for q in ITEM_COLS) + "), a as (" + " union all ".join(
    f"select id, '{q}' as item, cast({q} as double) as after_value from items" for q in ITEM_COLS) + """)
  select id, item, before_value, after_value, case when before_value is null then 'filled' when after_value is null then 'lost' else 'changed' end as change
  from b full join a using (id, item) where before_value is distinct from after_value""")
def _(t):
    return checks.stage_diff(raw_items(t), items(t), "id", ITEM_COLS)


@query("drop_all_null_rows", sql=f"with {OPT} select sid, alt, price is null as no_price from opt where price is not null or disc is not null")
def _(t):
    return checks.drop_all_null_rows(with_opt_out(choice_long(t)), ["price", "disc"]).select(
        "sid", "alt", F.col("price").isNull().alias("no_price"))


@query("listwise_delete", sql=f"with {RAW} select id, q1, q2, q3 from raw where q1 is not null and q2 is not null and q3 is not null")
def _(t):
    return checks.listwise_delete(raw_items(t).select("id", "q1", "q2", "q3"), ["q1", "q2", "q3"])


@query("mean_impute", doubles="q1 q5", sql=f"""with {RAW} select id, coalesce(cast(q1 as double), avg(q1) over ()) as q1,
  coalesce(cast(q5 as double), avg(q5) over ()) as q5 from raw""")
def _(t):
    return checks.mean_impute(raw_items(t).select("id", "q1", "q5"), ["q1", "q5"])


@query("cast_ids", sql="select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey from orders")
def _(t):
    return checks.cast_ids(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"])


@query("cast_choice", sql=f"with {LONG} select sid, alt, chosen from long")
def _(t):
    return checks.cast_choice(choice_long(t).select("sid", "alt", F.col("chosen").cast("double").alias("chosen")), "chosen")


@query("numeric_only", doubles="c_acctbal:2", sql="select c_custkey, c_nationkey, c_acctbal from customer")
def _(t):
    return checks.numeric_only(t.customer)


@query("variance_profile", doubles="variance:4", sql="""
  select 'c_custkey' as column_name, var_samp(c_custkey) as variance, var_samp(c_custkey) <= 0 as constant from customer
  union all select 'c_acctbal', var_samp(c_acctbal), var_samp(c_acctbal) <= 0 from customer
  union all select 'one', 0::DOUBLE, true""")
def _(t):
    return checks.variance_profile(t.customer.withColumn("one", F.lit(1)), ["c_custkey", "c_acctbal", "one"])


@query("drop_zero_variance", doubles="c_acctbal:2", sql="select c_custkey, c_acctbal from customer")
def _(t):
    df = t.customer.select("c_custkey", "c_acctbal", F.lit(7).alias("one"))
    return checks.drop_zero_variance(df, ["c_custkey", "c_acctbal", "one"])


@query("dedup_first", doubles="o_totalprice:2", sql="""select o_custkey, o_orderkey, o_totalprice from orders
  qualify row_number() over (partition by o_custkey order by o_orderkey) = 1""")
def _(t):
    return checks.dedup_first(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("keep_first_n_per_id", sql="""select o_custkey, o_orderkey from orders
  qualify row_number() over (partition by o_custkey order by o_orderkey) <= 6""")
def _(t):
    return checks.keep_first_n_per_id(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 6)


@query("duplicate_report", sql="""select l_orderkey, l_linenumber, cast(count(*) as bigint) as n_rows, cast(count(*) - 1 as bigint) as n_extra
  from lineitem group by all having count(*) > 1""")
def _(t):
    return checks.duplicate_report(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("duplicate_agreement", sql="""select l_orderkey, l_linenumber, cast(count(*) as bigint) as n_copies,
    count(distinct l_tax) = 1 as same_l_tax, count(distinct l_returnflag) = 1 as same_l_returnflag,
    count(distinct l_tax) = 1 and count(distinct l_returnflag) = 1 as all_same
  from lineitem group by l_orderkey, l_linenumber having count(*) > 1""")
def _(t):
    return checks.duplicate_agreement(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_tax", "l_returnflag"])


@query("suffix_duplicate_ids", sql="""select o_orderkey, case when k > 0 then o_custkey || '_' || k else o_custkey::VARCHAR end as unique_id
  from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k from orders)""")
def _(t):
    return checks.suffix_duplicate_ids(t.orders, "o_custkey", ["o_orderkey"]).select("o_orderkey", "unique_id")


@query("reassign_duplicate_ids", sql="""with r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as c from orders),
  e as (select *, row_number() over (order by o_custkey, o_orderkey) as k from r where c > 1),
  free as (select v, row_number() over (order by v) as k from (select unnest(range(1, (select max(o_custkey) + 1 from orders))) as v) where v not in (select o_custkey from orders))
  select o_orderkey, o_custkey, o_custkey as new_id from r where c = 1
  union all select o_orderkey, o_custkey, coalesce(v, (select max(o_custkey) from orders) + e.k - (select count(*) from free)) from e left join free on e.k = free.k""")
def _(t):
    return checks.reassign_duplicate_ids(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"])


@query("drop_opt_out_sets", sql=f"""with {LONG} select sid, alt, chosen from long where label <> 'R'
  and sid not in (select sid from long where chosen = 1 and label = 'R')""")
def _(t):
    return checks.drop_opt_out_sets(choice_long(t).select("sid", "alt", "chosen", "label"), ["sid"], "chosen",
                                    F.col("label") == "R").select("sid", "alt", "chosen")


@query("coalesce_suffixes", sql=f"with {RAW} select id, coalesce(q1, q5) as q1, nation from raw")
def _(t):
    df = raw_items(t).select("id", F.col("q1").alias("q1_dce"), F.col("q5").alias("q1_sem"), F.col("nation").alias("nation_dce"))
    return checks.coalesce_suffixes(df)


@query("validate_long_choice", sql=f"""with {LONG}, s as (select id, sid, sum(chosen) as c, count(*) as n, count(distinct alt) as k from long group by id, sid),
  i as (select id, sum(c) as c, count(*) as sets from s group by id)
  select 'one_choice_per_set' as rule, cast(count(*) filter (where c <> 1) as bigint) as n_bad from s
  union all select 'alternative_repeated', cast(count(*) filter (where n <> k) as bigint) from s
  union all select 'choices_per_id', cast(count(*) filter (where c <> sets) as bigint) from i""")
def _(t):
    return checks.validate_long_choice(choice_long(t), "id", "sid", "alt", "chosen")


# ---- encodings -------------------------------------------------------------------------------------------


@query("reverse_code", sql=f"with {RAW} select id, q1, 6 - q2 as q2, 6 - q6 as q6 from raw")
def _(t):
    return encode.reverse_code(raw_items(t).select("id", "q1", "q2", "q6"), REVERSED)


@query("reverse_code_verify", doubles="original_mean reversed_mean expected_mean diff", sql=f"with {RAW} " + " union all ".join(
    f"select '{q}' as item, avg({q}) as original_mean, avg(6 - {q}) as reversed_mean, 6 - avg({q}) as expected_mean, abs(avg(6 - {q}) - (6 - avg({q}))) as diff, true as success from raw"
    for q in REVERSED))
def _(t):
    raw = raw_items(t)
    return encode.reverse_code_verify(raw, encode.reverse_code(raw, REVERSED), REVERSED)


@query("reverse_code_summary", sql="""select event_type as factor, cast(count(*) as bigint) as n_items,
    cast(count(*) filter (where value < 50) as bigint) as n_reversed,
    string_agg(distinct case when value < 50 then (user_id // 50)::VARCHAR end, ',' order by case when value < 50 then (user_id // 50)::VARCHAR end) as reversed_items
  from events group by event_type""")
def _(t):
    dim = t.events.selectExpr("event_type as factor", "cast(user_id div 50 as string) as item", "value < 50 as is_reversed")
    return encode.reverse_code_summary(dim)


@query("level_map", sql="select l_orderkey, l_linenumber, case l_returnflag when 'A' then 1 when 'N' then 0 end as code from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", encode.level_map("l_returnflag", {"A": 1, "N": 0}).alias("code"))


@query("level_map_verify", sql="""select l_returnflag, case l_returnflag when 'A' then 1 when 'N' then 0 end as code,
  cast(count(*) as bigint) as n from lineitem group by all""")
def _(t):
    return encode.level_map_verify(t.lineitem.withColumn("code", encode.level_map("l_returnflag", {"A": 1, "N": 0})),
                                   "l_returnflag", "code")


@query("effects_code", doubles="coded", sql="""select l_orderkey, l_linenumber, case l_returnflag when 'A' then 1::DOUBLE when 'N' then -1::DOUBLE end as coded from lineitem""")
def _(t):
    return t.lineitem.withColumn("c", encode.level_map("l_returnflag", {"A": 1, "N": 0})).select(
        "l_orderkey", "l_linenumber", encode.effects_code("c").alias("coded"))


@query("ordinal_midpoint", doubles="midpoint", sql="""select c_custkey, case c_mktsegment when 'AUTOMOBILE' then 150::DOUBLE when 'BUILDING' then 250::DOUBLE
  when 'FURNITURE' then 350::DOUBLE when 'HOUSEHOLD' then 450::DOUBLE end as midpoint from customer""")
def _(t):
    return t.customer.select("c_custkey", encode.ordinal_midpoint("c_mktsegment", {
        "AUTOMOBILE": 150, "BUILDING": 250, "FURNITURE": 350, "HOUSEHOLD": 450}).alias("midpoint"))


def _z_sql(sd):
    return f"""with {OPT} select sid, alt, (price - avg(price) over ()) / {sd}(price) over () as price_z,
      (disc - avg(disc) over ()) / {sd}(disc) over () as disc_z from opt"""


@query("zscore_pop", doubles="price_z disc_z", sql=_z_sql("stddev_pop"))
def _(t):
    return encode.zscore_pop(with_opt_out(choice_long(t)), ["price", "disc"]).select("sid", "alt", "price_z", "disc_z")


@query("zscore_sample", doubles="price_z disc_z", sql=_z_sql("stddev_samp"))
def _(t):
    return encode.zscore_sample(with_opt_out(choice_long(t)), ["price", "disc"]).select("sid", "alt", "price_z", "disc_z")


@query("zscore_apply", doubles="s_acctbal_z", sql="""select s_suppkey, (s_acctbal - m) / s as s_acctbal_z
  from supplier, (select avg(c_acctbal) as m, stddev_pop(c_acctbal) as s from customer)""")
def _(t):
    stats = encode.scale_stats(t.customer.withColumnRenamed("c_acctbal", "s_acctbal"), ["s_acctbal"], 0)
    return encode.zscore_apply(t.supplier, ["s_acctbal"], stats).select("s_suppkey", "s_acctbal_z")


@query("zscore_inverse", doubles="c_acctbal_back:4", sql="select c_custkey, c_acctbal as c_acctbal_back from customer")
def _(t):
    stats = encode.scale_stats(t.customer, ["c_acctbal"], 0)
    z = encode.zscore_apply(t.customer, ["c_acctbal"], stats)
    return encode.zscore_inverse(z, ["c_acctbal"], stats).select("c_custkey", "c_acctbal_back")


@query("center", doubles="c_acctbal_c:4", sql="select c_custkey, c_acctbal - avg(c_acctbal) over () as c_acctbal_c from customer")
def _(t):
    return encode.center(t.customer, ["c_acctbal"]).select("c_custkey", "c_acctbal_c")


@query("scale_by", doubles="price", sql="select l_orderkey, l_linenumber, l_extendedprice / 1000 as price from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", encode.scale_by("l_extendedprice", 1000).alias("price"))


@query("alt_dummy", sql="select l_orderkey, l_linenumber, case when l_linenumber = 2 then 1 else 0 end as is_second from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", encode.alt_dummy("l_linenumber", 2, "is_second"))


@query("interact_product", doubles="xz", sql=f"with {SCORES} select id, sa * sb as xz from scores")
def _(t):
    return scores(t).select("id", encode.interact_product("sa", "sb").alias("xz"))


@query("interact_residual", doubles="xz_resid", sql=f"""with {SCORES}, m as (select avg(sa) as mx, avg(sb) as mz, avg(sa * sb) as mp, var_pop(sa) as vx, var_pop(sb) as vz,
    covar_pop(sa, sb) as c, covar_pop(sa, sa * sb) as cx, covar_pop(sb, sa * sb) as cz from scores),
  b as (select *, (vz * cx - c * cz) / (vx * vz - c * c) as bx, (vx * cz - c * cx) / (vx * vz - c * c) as bz from m)
  select id, sa * sb - mp - bx * (sa - mx) - bz * (sb - mz) as xz_resid from scores, b""")
def _(t):
    return encode.interact_residual(scores(t), "sa", "sb").select("id", "xz_resid")


@query("interact_typed", doubles=" ".join(encode.INTERACTIONS), sql=f"""with {LONG}, b as (select sid, alt, cast(label = 'A' as integer) as s, cast(disc > 0.05 as integer) as h, price as p, price / 1000 as pn from long)
  select sid, alt, cast(s * h as double) as sugar_health, s * p as sugar_price, h * p as health_price, s * h * pn as three_way,
    cast(s * h as double) as sugar_health_normalized, s * pn as sugar_price_normalized, h * pn as health_price_normalized from b""")
def _(t):
    df = choice_long(t).select("sid", "alt", "price", (F.col("price") / 1000).alias("pn"),
                               (F.col("label") == "A").cast("double").alias("s"), (F.col("disc") > 0.05).cast("double").alias("h"))
    out = encode.interact_typed(df, {"sugar_free": "s", "health_label": "h", "price": "price", "price_normalized": "pn"})
    return out.select("sid", "alt", *encode.INTERACTIONS)


@query("interact_factor_attr", doubles="sa_direct sb_direct sa_x_price:4 sa_x_disc sb_x_price:4 sb_x_disc", sql=f"""with {LONG}, {SCORES}
  select sid, alt, sa as sa_direct, sb as sb_direct, sa * price as sa_x_price, sa * disc as sa_x_disc, sb * price as sb_x_price, sb * disc as sb_x_disc
  from long left join scores on long.id = scores.id""")
def _(t):
    df = choice_long(t).join(scores(t).select("id", "sa", "sb"), "id", "left")
    out = encode.interact_factor_attr(df, ["sa", "sb"], ["price", "disc"])
    return out.select("sid", "alt", *[c for c in out.columns if "_direct" in c or "_x_" in c])


_NORM = "value / 100"


@query("bin_fixed", sql=f"""select event_id, case when {_NORM} < 0 then null when {_NORM} <= 0.33 then 'Low' when {_NORM} <= 0.67 then 'Medium'
  when {_NORM} <= 1 then 'High' end as bin from events""")
def _(t):
    return t.events.withColumn("v", F.col("value") / 100).select("event_id", encode.bin_fixed("v").alias("bin"))


@query("bin_tertile", sql="""with q as (select quantile_cont(l_extendedprice, 0.33) as lo, quantile_cont(l_extendedprice, 0.67) as hi from lineitem)
  select l_orderkey, l_linenumber, l_partkey, case when l_extendedprice <= lo then 'Low' when l_extendedprice <= hi then 'Medium' else 'High' end as tertile from lineitem, q""")
def _(t):
    return encode.bin_tertile(t.lineitem, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "tertile")


@query("signif_stars", doubles="p:4", sql="""select event_id, value / 100 as p, case when value / 100 < 0.001 then '***' when value / 100 < 0.01 then '**' when value / 100 < 0.05 then '*' else '' end as stars,
  case when value / 100 < 0.001 then '***' when value / 100 < 0.01 then '**' when value / 100 < 0.05 then '*' when value / 100 < 0.1 then '.' else '' end as stars4 from events""")
def _(t):
    from ..functions.scalars import STARS_WITH_DOT, signif_stars
    p = F.col("value") / 100
    return t.events.select("event_id", p.alias("p"), signif_stars(p).alias("stars"), signif_stars(p, STARS_WITH_DOT).alias("stars4"))


@query("grade_fit_index", sql="""select event_id, case event_type when 'view' then 'CFI' when 'click' then 'RMSEA' when 'error' then 'SRMR' else 'TLI' end as name,
  case when event_type in ('click', 'error') then case when value / 100 <= 0.05 then 'Excellent' when value / 100 <= 0.08 then 'Good' else 'Poor' end
    else case when value / 100 >= 0.95 then 'Excellent' when value / 100 >= 0.90 then 'Good' else 'Poor' end end as grade from events""")
def _(t):
    name = F.expr("case event_type when 'view' then 'CFI' when 'click' then 'RMSEA' when 'error' then 'SRMR' else 'TLI' end")
    return t.events.select("event_id", name.alias("name"), encode.grade_fit_index(name, F.col("value") / 100).alias("grade"))


@query("grade_loading", sql="""select event_id, case when abs(value / 50 - 1) >= 0.7 then 'Strong' when abs(value / 50 - 1) >= 0.5 then 'Moderate'
  when abs(value / 50 - 1) >= 0.3 then 'Weak' else 'Very Weak' end as grade from events""")
def _(t):
    return t.events.select("event_id", encode.grade_loading(F.col("value") / 50 - 1).alias("grade"))


@query("param_group", sql=f"""with {_PARAM_SQL} select parameter, case when parameter like 'theta%' then 'choice_lv' when parameter like 'gamma%' then 'structural' else 'choice_fixed' end as part,
  cast(count(*) as bigint) as n from params group by all""")
def _(t):
    return (run_params(t).withColumn("part", encode.param_group(F.col("parameter"))).groupBy("parameter", "part")
            .agg(F.count(F.lit(1)).alias("n")))


@query("factor_score_mean", doubles="fa fb", sql=f"""with {RAW} select id,
  list_avg([cast(q1 as double), q2, q3, q4]) as fa, list_avg([cast(q5 as double), q6, q7]) as fb from raw""")
def _(t):
    return raw_items(t).select("id", encode.factor_score_mean(FACTORS["A"]).alias("fa"), encode.factor_score_mean(FACTORS["B"]).alias("fb"))


@query("factor_score_sum", doubles="fa fb", sql=f"""with {RAW} select id,
  coalesce(q1, 0)::DOUBLE + coalesce(q2, 0) + coalesce(q3, 0) + coalesce(q4, 0) as fa, coalesce(q5, 0)::DOUBLE + coalesce(q6, 0) + coalesce(q7, 0) as fb from raw""")
def _(t):
    return raw_items(t).select("id", encode.factor_score_sum(FACTORS["A"]).alias("fa"), encode.factor_score_sum(FACTORS["B"]).alias("fb"))


