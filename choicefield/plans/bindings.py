"""Role bindings: the driver tables read as survey and choice-experiment data (FIXTURES.md, part B).

Each binding exists twice, as a DataFrame and as a CTE text for the oracle SQL.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.groups import has_hot_group, numbered, with_group_values
from ..functions.normal import two_sided_p
from ..operators.stats import inline
from .registry import Tables

# ---- long choice table: id = customer, sid = order, one row per order line -------------------------

LONG = """long as (
  select o_custkey as id, l_orderkey as sid,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as alt,
    cast(case when row_number() over (partition by l_orderkey
      order by l_quantity desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1 then 1 else 0 end as integer) as chosen,
    l_extendedprice as price, l_discount as disc, l_tax as tax, l_returnflag as label, l_quantity as qty
  from lineitem join orders on l_orderkey = o_orderkey)"""

# attributes of opt-out rows (label R) are null
OPT = LONG + """, opt as (
  select id, sid, alt, chosen, label,
    case when label <> 'R' then price end as price, case when label <> 'R' then disc end as disc,
    case when label <> 'R' then tax end as tax
  from long)"""

# price on a common scale without a data pass: thousands
SCALED = LONG + """, scaled as (
  select id, sid, alt, chosen, label, price / 10000 as p, disc * 10 as d, tax * 10 as x from long)"""

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def sets_are_hot(t: Tables) -> bool:
    """Asked once per query, of the key column of the base table."""
    if "sets_are_hot" not in t.facts:
        t.facts["sets_are_hot"] = has_hot_group(t.lineitem, ["l_orderkey"])
    return t.facts["sets_are_hot"]


def lines(t: Tables, number: bool) -> DataFrame:
    """Order lines with a 0/1 mark on the line of largest quantity of each order, and their position."""
    line = t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag", "l_discount", "l_tax", *LINE_ORDER)
    split = sets_are_hot(t)
    key = F.struct((-F.col("l_quantity")).alias("q"), *LINE_ORDER)
    best = with_group_values(line, ["l_orderkey"], {"best": F.min(key)}, split=split)
    best = best.withColumn("chosen", (F.col("best") == key).cast("int")).drop("best")
    return numbered(best, ["l_orderkey"], LINE_ORDER, "alt", split=split) if number else best


def _named(df: DataFrame, t: Tables, *extra) -> DataFrame:
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    return df.join(orders, "l_orderkey").select(
        "id", F.col("l_orderkey").alias("sid"), *extra, "chosen", F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("label"),
        F.col("l_quantity").alias("qty"))


def choice_rows(t: Tables) -> DataFrame:
    """Long choice table without the position column (saves one window where it is not needed)."""
    return _named(lines(t, False), t)


def choice_long(t: Tables) -> DataFrame:
    return _named(lines(t, True), t, "alt")


def with_opt_out(long: DataFrame) -> DataFrame:
    keep = F.col("label") != "R"
    return long.select(*[c for c in ("id", "sid", "alt", "chosen", "label") if c in long.columns],
                       *[F.when(keep, F.col(c)).alias(c) for c in ("price", "disc", "tax")])


def scaled(long: DataFrame) -> DataFrame:
    return long.select(*[c for c in ("id", "sid", "alt", "chosen", "label") if c in long.columns],
                       (F.col("price") / 10000).alias("p"), (F.col("disc") * 10).alias("d"),
                       (F.col("tax") * 10).alias("x"))


# ---- questionnaire items and individual scores ------------------------------------------------------

FACTORS = {"A": ["q1", "q2", "q3", "q4"], "B": ["q5", "q6", "q7"]}
REVERSED = ["q2", "q6"]
ITEM_COLS = [q for items in FACTORS.values() for q in items]


def _item_exprs(div: str) -> list[str]:
    fa = "cast(floor((c_acctbal + 1000) / 2200) as bigint)"
    key = lambda d: f"(c_custkey {div} {d})"
    out = [f"least(5, greatest(1, {fa} + {key(d)} % 3))" for d in (1, 3, 9, 27)]
    out += [f"least(5, greatest(1, c_nationkey % 5 + ({key(7)} + {key(d)}) % 3))" for d in (1, 3, 9)]
    return [f"cast({e} as integer)" for e in out]


def _raw_exprs(div: str) -> list[str]:
    """As asked in the questionnaire: q2, q6 reversed, one answer in 17 missing."""
    out = []
    for k, (q, e) in enumerate(zip(ITEM_COLS, _item_exprs(div)), start=1):
        stored = f"6 - {e}" if q in REVERSED else e
        out.append(f"case when c_custkey % 17 <> {k} then {stored} end as {q}")
    return out


RAW = ("raw as (select c_custkey as id, c_nationkey as nation, c_mktsegment as segment, c_acctbal as balance, "
       + ", ".join(_raw_exprs("//")) + " from customer)")
ITEMS = ("items as (select c_custkey as id, c_nationkey as nation, c_mktsegment as segment, c_acctbal as balance, "
         + ", ".join(f"{e} as {q}" for q, e in zip(ITEM_COLS, _item_exprs("//"))) + " from customer)")
SCORES = ITEMS + """, spend as (select o_custkey as id, avg(o_totalprice) as spend from orders group by o_custkey),
  scores as (select items.id, segment, nation, (q1 + q2 + q3 + q4) / 4.0::DOUBLE as sa, (q5 + q6 + q7) / 3.0::DOUBLE as sb,
    (spend - avg(spend) over ()) / stddev_pop(spend) over () as sc
  from items left join spend on items.id = spend.id)"""


def _customer(t: Tables, exprs: list[str]) -> DataFrame:
    return t.customer.selectExpr("c_custkey as id", "c_nationkey as nation", "c_mktsegment as segment",
                                 "c_acctbal as balance", *exprs)


def raw_items(t: Tables) -> DataFrame:
    return _customer(t, _raw_exprs("div"))


def items(t: Tables) -> DataFrame:
    return _customer(t, [f"{e} as {q}" for q, e in zip(ITEM_COLS, _item_exprs("div"))])


def scores(t: Tables) -> DataFrame:
    """Individual scores: factor means sa, sb and z-scored mean spending sc."""
    spend = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("spend"))
    m = spend.agg(F.struct(F.avg("spend").alias("mu"), F.stddev_pop("spend").alias("sd")).alias("m")).scalar()
    z = spend.withColumn("m", m).select("id", ((F.col("spend") - F.col("m.mu")) / F.col("m.sd")).alias("sc"))
    own = items(t).selectExpr("id", "segment", "nation", "(q1 + q2 + q3 + q4) / 4.0D as sa",
                              "(q5 + q6 + q7) / 3.0D as sb")
    return own.join(z, "id", "left")


# ---- runs: one estimated model per brand, parameters per part type --------------------------------------

RUNS = """runs as (
  select p_brand as run, p_type as parameter, avg(l_discount) as estimate,
    stddev_samp(l_discount) / sqrt(count(*)) as std_error, max(l_shipdate) as run_ts,
    cast(count(*) as bigint) as n, sum(l_discount * l_discount) as ss
  from lineitem join part on l_partkey = p_partkey group by p_brand, p_type)"""


def runs(t: Tables) -> DataFrame:
    return (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_brand").alias("run"), F.col("p_type").alias("parameter"))
            .agg(F.avg("l_discount").alias("estimate"),
                 (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("std_error"),
                 F.max("l_shipdate").alias("run_ts"), F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("l_discount") * F.col("l_discount")).alias("ss")))


# ---- replicates and iteration trace ---------------------------------------------------------------------

REPLICATES = """replicates as (
  select event_id as replicate, event_type as parameter, value - 50 as value from events)"""
TRACE = """trace as (
  select user_id as run, ts, event_id as iteration, -value as ll, event_type as status from events)"""


def replicates(t: Tables) -> DataFrame:
    return t.events.selectExpr("event_id as replicate", "event_type as parameter", "value - 50 as value")


def trace(t: Tables) -> DataFrame:
    return t.events.selectExpr("user_id as run", "ts", "event_id as iteration", "-value as ll", "event_type as status")


# ---- normal law in SQL (the oracle engine has no erf either) ----------------------------------------------


def _horner(coefs, x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out}*{x}+{c!r})"
    return out


def sql_norm_cdf(x: str) -> str:
    """Phi(x) for a column name or short expression; e-notation keeps the literals DOUBLE."""
    a = f"abs({x})"
    num, den = _horner([float(c) for c in normal.HART_NUM], a), _horner([float(c) for c in normal.HART_DEN], a)
    num, den = f"CAST({num} AS DOUBLE)", f"CAST({den} AS DOUBLE)"
    frac = f"({a}+0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        frac = f"({a}+{k}::DOUBLE/{frac})"
    e = f"exp(-{a}*{a}/2)"
    tail = (f"(case when {a} > 37 then 0::DOUBLE when {a} < {normal.HART_SPLIT!r} then {e}*{num}/{den} "
            f"else {e}/{frac}/{normal.SQRT_2PI!r} end)")
    return f"(case when {x} > 0 then 1-{tail} else {tail} end)"


def sql_norm_pdf(x: str) -> str:
    return f"(exp(-({x})*({x})/2)/{normal.SQRT_2PI!r})"


def sql_norm_ppf(p: str) -> str:
    def ratio(pair, r):
        return f"(CAST({_horner([float(c) for c in pair[0]], r)} AS DOUBLE)/CAST({_horner([float(c) for c in pair[1]], r)} AS DOUBLE))"
    q = f"({p}-0.5::DOUBLE)"
    r = f"sqrt(-ln(least({p},1-{p})))"
    centre = f"{q}*{ratio(normal.AS241_CENTRE, f'(0.180625::DOUBLE-{q}*{q})')}"
    outer = f"(case when {r} <= 5 then {ratio(normal.AS241_MIDDLE, f'({r}-1.6::DOUBLE)')} else {ratio(normal.AS241_TAIL, f'({r}-5)')} end)"
    return f"(case when abs({q}) <= 0.425 then {centre} when {q} < 0 then -{outer} else {outer} end)"


# ---- path tables: simple regressions between four individual scores, one model per segment -----------------

NODES = ["sa", "sb", "sc", "sd"]
COMPLETE = SCORES.replace("segment, nation, (q1", "segment, nation, balance / 10000 as sd, (q1") + """,
  complete as materialized (select * from scores where sc is not null)"""
# one pass over the scores, materialised: joined with itself, it must not be computed once for each use
PATHS = COMPLETE + """, paths as materialized (select model, e.lval as lval, e.rval as rval, e.estimate as estimate, e.std_err as std_err from (
  select segment as model, unnest([""" + ", ".join(
    f"""{{'lval': '{l}', 'rval': '{r}', 'estimate': regr_slope({l}, {r}),
  'std_err': sqrt((1 - corr({l}, {r}) * corr({l}, {r})) * var_samp({l}) / var_samp({r}) / (count(*) - 2))}}""" for r, l in permutations(NODES, 2)) + "]) as e from complete group by segment))"


def complete_scores(t: Tables) -> DataFrame:
    sd = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("sd"))
    return scores(t).join(sd, "id").filter("sc is not null")


def paths(t: Tables) -> DataFrame:
    edges = list(permutations(NODES, 2))
    wide = complete_scores(t).groupBy(F.col("segment").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), *[F.var_samp(c).alias(f"v_{c}") for c in NODES],
        *[F.covar_samp(r, l).alias(f"c_{r}_{l}") for r, l in edges])
    rows = []
    for r, l in edges:
        c, vr, vl = F.col(f"c_{r}_{l}"), F.col(f"v_{r}"), F.col(f"v_{l}")
        rows.append({"lval": F.lit(l), "rval": F.lit(r), "estimate": c / vr,
                     "std_err": F.sqrt((1 - c * c / vr / vl) * vl / vr / (F.col("n") - 2))})
    return inline(wide, ["model"], rows)


def nodes(t: Tables) -> DataFrame:
    per = complete_scores(t).groupBy(F.col("segment").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("model", F.explode(F.array(*[F.lit(n) for n in NODES])).alias("node"))


# ---- result rows of estimated models -------------------------------------------------------------------------

PARAM_NAMES = {"ECONOMY": "theta_sugar_purchase_intention", "SMALL": "gamma_sugar_purchase_intention_price",
               "PROMO": "theta_sugar_free_nutrition_knowledge", "LARGE": "gamma_sugar_free_nutrition_knowledge_price",
               "MEDIUM": "beta_price", "STANDARD": "asc_sugar"}
RESULTS = RUNS + """, z as (select run, parameter, estimate - 0.0497123 as b, std_error, (estimate - 0.0497123) / std_error as z from runs),
  results as (select run, 'Parameters' as section, case parameter """ + " ".join(
    f"when '{k}' then '{v}'" for k, v in PARAM_NAMES.items()) + f""" end as parameter,
    b as estimate, std_error, 2 * {sql_norm_cdf('(-abs(z))')} as p_value from z
  union all select run, 'Model_Fit', 'LL', -sum(n) / 10.0::DOUBLE, null, null from runs group by run
  union all select run, 'Model_Fit', 'AIC', sum(n) / 5.0::DOUBLE + 2 * count(*), null, null from runs group by run
  union all select run, 'Model_Fit', 'BIC', sum(n) / 5.0::DOUBLE + ln(sum(n)) * count(*), null, null from runs group by run)"""


def results(t: Tables) -> DataFrame:
    r = runs(t)
    names = F.create_map(*[F.lit(x) for kv in PARAM_NAMES.items() for x in kv])
    b = F.col("estimate") - 0.0497123
    params = r.select("run", F.lit("Parameters").alias("section"), names[F.col("parameter")].alias("parameter"), b.alias("estimate"),
                      "std_error", two_sided_p(b / F.col("std_error")).alias("p_value"))
    per = r.groupBy("run").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    n, k = F.col("n"), F.col("k")
    none = F.lit(None).cast("double")
    fit = [{"section": F.lit("Model_Fit"), "parameter": F.lit(name), "estimate": v, "std_error": none, "p_value": none}
           for name, v in (("LL", -n / 10), ("AIC", n / 5 + 2 * k), ("BIC", n / 5 + F.log(n) * k))]
    return params.unionByName(inline(per, ["run"], fit))


# ---- item loadings --------------------------------------------------------------------------------------------

LOADINGS = ITEMS + ", loadings as (" + " union all ".join(
    f"select '{f}' as factor, '{q}' as item, corr({q}, {' + '.join(cols)}) as loading from items" for f, cols in FACTORS.items() for q in cols) + ")"
