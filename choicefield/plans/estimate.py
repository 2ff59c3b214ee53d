"""Fitted models on the driver tables (iterative, hence without SQL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..estimators import choice, linear, pipeline, simulated
from ..operators import encode, kernels, shape
from .bindings import FACTORS, ITEM_COLS, LONG, choice_rows, complete_scores, items, scaled, scores
from .choice import eta_rows, relative
from .describe import RICH, rich
from .registry import query

ATTRS = ["p", "d", "x"]
DIMENSIONS = 64


def _long(t):
    """Scaled rows with an alternative-specific column ``buy`` (0 on opt-out rows)."""
    return scaled(choice_rows(t)).withColumn("buy", (F.col("label") != "R").cast("double"))


@query("fit_mnl")
def _(t):
    return choice.fit_mnl(_long(t), ["sid"], ATTRS, key="id").report(t.spark)


@query("fit_mnl_statistics")
def _(t):
    return choice.fit_mnl(_long(t), ["sid"], ATTRS, key="id").statistics(t.spark).drop("max_gradient")


@query("robust_se")
def _(t):
    return choice.fit_mnl(_long(t), ["sid"], ATTRS, key="id", robust=True).coefficients(t.spark)


@query("opg_covariance")
def _(t):
    s = kernels.individual_scores(relative(t), "id", ["sid"], {"p": 0.0, "d": 0.0, "x": 0.0})
    return choice.opg_covariance(s, ATTRS)


@query("fit_binary_probit")
def _(t):
    return choice.fit_binary_probit(_long(t), ["p", "d"]).report(t.spark)


@query("fit_ordered_probit")
def _(t):
    """All seven items, each given the latent score."""
    fits = choice.fit_ordered_probit(eta_rows(t), "eta", ITEM_COLS)
    return reduce(lambda x, y: x.unionByName(y), [f.report(t.spark).withColumn("item", F.lit(i)) for i, f in fits.items()])


@query("fit_binary_probit_robust")
def _(t):
    return choice.fit_binary_probit(_long(t), ["p", "d"], robust=True).report(t.spark)


@query("fit_rpl")
def _(t):
    return simulated.fit_rpl(_long(t), "id", ["sid"], ["p", "d"], ["d"]).report(t.spark)


@query("fit_rpl_robust")
def _(t):
    """Sandwich errors, and draws with permuted digits."""
    return simulated.fit_rpl(_long(t), "id", ["sid"], ["p", "d"], ["d"], n_draws=50, robust=True, scramble=7).report(t.spark)


def _people(t, centred: bool):
    shift = "" if not centred else " - 3.0D"
    return items(t).selectExpr("id", *[f"{q}{shift} as {q}" for q in ITEM_COLS], "balance / 5000 - 1 as wealth")


@query("fit_iclv_simultaneous")
def _(t):
    """One latent variable behind all items of its factor."""
    return simulated.fit_iclv_simultaneous(_long(t), _people(t, True), "id", ["sid"], ["p"], "buy", FACTORS["A"], ["wealth"]).report(t.spark)


@query("fit_joint_paths")
def _(t):
    """Two latent variables, the second predicted by the first, behind ordered answers to all seven items."""
    kinds = {lv: dict.fromkeys(cols, "ordered") for lv, cols in FACTORS.items()}
    fit = simulated.fit_joint(_long(t), _people(t, False), "id", ["sid"], ["p"], {"A": ["wealth"], "B": ["A"]}, kinds, [("A", "buy"), ("B", "p")], n_draws=50)
    return fit.report(t.spark)


@query("fit_iclv_sequential")
def _(t):
    return pipeline.fit_iclv_sequential(_long(t), items(t), "id", ["sid"], ["p", "buy"], FACTORS, {"A": "buy"}, [("B", "p")], [("B", "A")]).coefficients(t.spark)


@query("hybrid_analysis")
def _(t):
    return pipeline.hybrid_analysis(_long(t), items(t), "id", ["sid"], ["p", "d", "buy"], FACTORS, {"A": "buy", "B": "buy"})


@query("compare_choice_models")
def _(t):
    df = _long(t)
    fits = {"logit": choice.create_model("logit")(df, ["p", "d"], "chosen"), "probit": choice.create_model("probit")(df, ["p", "d"]),
            "conditional_logit": choice.create_model("mnl")(df, ["sid"], ["p", "d"])}
    return pipeline.compare_choice_models(fits, t.spark)


@query("run_model_grid")
def _(t):
    """Every model of the grid over two scores and two attributes."""
    s = scores(t).select("id", "sa", "sb")
    grid = shape.model_grid(t.spark.range(1), ["sa", "sb"], ["p", "d"])
    return pipeline.run_model_grid(_long(t), s, "id", ["sid"], ["p", "d", "buy"], pipeline.grid_models(grid, {"sa": "buy", "sb": "buy"}))


@query("fit_logit_component")
def _(t):
    return choice.fit_logit(rich(t), ["h"], "chosen", l2=1.0).coefficients(t.spark)


@query("fit_logit_standardized")
def _(t):
    return choice.fit_logit(rich(t), ["price", "disc", "tax"], "chosen", standardise=True).coefficients(t.spark)


def _embedded(t):
    """All components of the vectors with a 0/1 label."""
    emb = t.embeddings.select(F.col("vec_id").alias("doc_id"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMENSIONS)])
    return emb.join(t.labels, "doc_id").dropna()


@query("fit_logit_embeddings")
def _(t):
    return choice.fit_logit(_embedded(t), [f"e{i}" for i in range(DIMENSIONS)], "quality", l2=1.0, robust=True).report(t.spark)


@query("gram_embeddings", doubles="value", sql=f"""with x as (select unnest(range({DIMENSIONS})) as i, vec_id from embeddings),
  long as (select vec_id, i, embedding[i + 1]::DOUBLE as v from x join embeddings using (vec_id) where embedding[i + 1] is not null)
  select 'e' || a.i as row, 'e' || b.i as col, sum(a.v * b.v) as value from long a join long b on a.vec_id = b.vec_id and a.i <= b.i group by a.i, b.i""")
def _(t):
    """Outer products of many columns at once: 2,080 sums in one block a partition."""
    cols = [f"g_e{i}" for i in range(DIMENSIONS)]
    wide = t.embeddings.select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    return kernels.opg_matrix(wide, cols)


@query("fit_linear_component", doubles="coefficient:9", sql=f"with {LONG} select regr_slope(chosen, disc) as coefficient from long")
def _(t):
    return linear.fit_linear_component(choice_rows(t), "disc", "chosen")


@query("fit_corr_component", doubles="coefficient", sql=f"with {LONG} select corr(price, chosen) as coefficient from long")
def _(t):
    return linear.fit_corr_component(choice_rows(t), "price", "chosen")


@query("fit_product_component", doubles="coefficient non_zero_rate", sql=f"with {RICH} select regr_slope(chosen, a * h) as coefficient, avg(case when a * h <> 0 then 1::DOUBLE else 0 end) as non_zero_rate from rich")
def _(t):
    return linear.fit_product_component(rich(t), ["a", "h"], "chosen")


@query("vif", doubles="vif", sql=f"""with {LONG} select 'price' as variable, 1 / (1 - power(corr(price, disc), 2)) as vif from long union all select 'disc', 1 / (1 - power(corr(price, disc), 2)) from long""")
def _(t):
    return linear.vif(choice_rows(t), ["price", "disc"])


@query("ols")
def _(t):
    return linear.ols(encode.center(complete_scores(t), ["sa"]), "sc", ["sa_c", "sb", "sd"])
