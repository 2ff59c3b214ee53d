"""Two-stage estimation and runs over several models."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import two_sided_p
from ..operators import kernels, shape
from ..operators.encode import center, zscore_pop
from ..operators.models import model_table
from . import choice, grid
from .newton import Fit
from .stages import FactorScorer


def stage1_scores(items: DataFrame, key: str, factors: dict[str, list[str]], paths: list = (), scale: str = "zscore") -> DataFrame:
    """Stage 1: fit the factor/path model on covariances, score every individual by its loadings, scale the scores.

    The loadings are a handful of numbers, so scoring is a column expression without a shuffle. Returns (key, <factor>...): a keyed table, so later steps join instead of relying on row order.
    """
    cols = list(factors)
    scored = FactorScorer(factors, list(paths)).fit(items).transform(items).select(key, *cols)
    scaled = zscore_pop(scored, cols) if scale == "zscore" else center(scored, cols, "_z")
    return scaled.select(key, *[F.col(f"{c}_z").alias(c) for c in cols])


def with_lv_terms(long: DataFrame, scores: DataFrame, key: str, main: dict[str, str], interactions: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Join the scores and add the terms of a choice model: ``main``: score -> column it shifts (a score is the same for
    all alternatives of a set, so it acts through an alternative-specific column), ``interactions``: (score, attribute)."""
    df = shape.attach_scores(long, scores, key, [c for c in scores.columns if c != key])
    terms = {f"theta_{lv}": F.col(lv) * F.col(c) for lv, c in main.items()}
    terms |= {f"gamma_{lv}_{a}": F.col(lv) * F.col(a) for lv, a in interactions}
    return df.withColumns(terms), list(terms)


def fit_iclv_sequential(long: DataFrame, items: DataFrame, key: str, set_keys: list[str], attrs: list[str], factors: dict[str, list[str]],
                        main: dict[str, str], interactions: list[tuple[str, str]] = (), paths: list = (), chosen: str = "chosen") -> Fit:
    """Stage 1 scores -> stage 2 conditional logit with LV terms."""
    scores = stage1_scores(items, key, factors, paths)
    df, terms = with_lv_terms(long, scores, key, main, list(interactions))
    return choice.fit_mnl(df, set_keys, [*attrs, *terms], chosen, key)


def grid_models(rows: DataFrame, main: dict[str, str], limit: int = 5000) -> dict[str, dict]:
    """The rows of ``shape.model_grid`` as models (name -> {main, interactions}). ``main``: score -> column it shifts."""
    rows = rows.select("main_lvs", "interactions").distinct().orderBy("main_lvs", "interactions").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} models in the grid; raise the limit")
    out = {}
    for r in rows:
        lvs, pairs = [x for x in r.main_lvs.split(",") if x], [tuple(x.split(":")) for x in r.interactions.split(",") if x]
        out["+".join(["base", *lvs, *[f"{lv}:{a}" for lv, a in pairs]])] = {"main": {lv: main[lv] for lv in lvs}, "interactions": pairs}
    return out


def run_model_grid(long: DataFrame, scores: DataFrame, key: str, set_keys: list[str], attrs: list[str], models: dict[str, dict],
                   chosen: str = "chosen") -> DataFrame:
    """Fit every model (name -> {main, interactions}) from one score table and one prepared design: result rows.

    The design holds the union of all terms; all models take their Newton step in one job (``grid``).
    """
    main = {lv: c for m in models.values() for lv, c in m.get("main", {}).items()}
    inter = list(dict.fromkeys(p for m in models.values() for p in m.get("interactions", [])))
    df, terms = with_lv_terms(long, scores, key, main, inter)
    rel = kernels.relative_design(df, set_keys, [*attrs, *terms], chosen, [key])
    use = {name: [*attrs, *[f"theta_{lv}" for lv in m.get("main", {})], *[f"gamma_{lv}_{a}" for lv, a in m.get("interactions", [])]] for name, m in models.items()}
    return fits_table(grid.fit_together(rel, set_keys, use), long.sparkSession)


def fits_table(fits: dict[str, Fit], spark) -> DataFrame:
    """(run, section, parameter, estimate, std_error, p_value) of many fits, as ``Fit.result_rows`` has them, and whether each converged."""
    rows, none = [], None
    for run, fit in fits.items():
        k, ll = len(fit.names), fit.point.ll
        rows += [(run, "Parameters", n, float(b), float(s), fit.converged) for n, b, s in zip(fit.names, fit.theta, fit.std_errors())]
        rows += [(run, "Model_Fit", n, v, none, fit.converged) for n, v in (("LL", ll), ("AIC", 2 * k - 2 * ll), ("BIC", k * math.log(max(fit.n_obs, 1)) - 2 * ll))]
    table = spark.createDataFrame(rows, "run string, section string, parameter string, estimate double, std_error double, converged boolean")
    z = F.when(F.col("std_error") > 0, F.abs(F.col("estimate") / F.col("std_error")))
    return table.withColumn("z", z).withColumn("p_value", two_sided_p(F.col("z"))).select("run", "section", "parameter", "estimate", "std_error", "p_value", "converged")


def compare_choice_models(fits: dict[str, Fit], spark) -> DataFrame:
    """One row per fitted model, best AIC first by name."""
    return model_table(reduce(lambda a, b: a.unionByName(b), [f.result_rows(spark, n) for n, f in fits.items()]), "run")


def hybrid_analysis(long: DataFrame, items: DataFrame, key: str, set_keys: list[str], attrs: list[str], factors: dict[str, list[str]],
                    main: dict[str, str], chosen: str = "chosen") -> DataFrame:
    """End to end: scores, a model without and one with latent variables, and a binary logit, as one model table."""
    spark = long.sparkSession
    scores = stage1_scores(items, key, factors)
    df, terms = with_lv_terms(long, scores, key, main, [])
    rel = choice.prepare_mnl(df, set_keys, [*attrs, *terms], chosen, key)
    fits = {"attributes": choice.fit_mnl(None, set_keys, attrs, rel=rel), "attributes_and_lv": choice.fit_mnl(None, set_keys, [*attrs, *terms], rel=rel),
            "binary_logit": choice.create_model("logit")(long, attrs, chosen)}
    rel.unpersist()
    return compare_choice_models(fits, spark)


def score_check(rel: DataFrame, fit: Fit, set_keys: list[str]) -> DataFrame:
    """Gradient at the estimates (0 at the optimum)."""
    return kernels.mnl_gradient(rel, set_keys, fit.params)
