"""Many models in one job: equal to single fits, also over slices and salted sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicefield.estimators import choice, grid, pipeline
from choicefield.functions import groups
from choicefield.operators import kernels, shape
from test_estimators import choices


@pytest.mark.parametrize("mode", ["whole", "slices", "salted"])
def test_each_model_equals_its_single_fit(spark, monkeypatch, mode):
    df = spark.createDataFrame(choices(n=80)).withColumn("x3", F.col("x1") * F.col("x2")).withColumn("x4", F.sin("x1"))
    rel = kernels.relative_design(df, ["sid"], ["x1", "x2", "x3", "x4"], "chosen").cache()
    if mode == "slices":
        monkeypatch.setattr(grid, "SLICE", 10)
    if mode == "salted":
        monkeypatch.setattr(groups, "HOT_ROWS", 2)
        monkeypatch.setattr(groups, "RANGES", 2)
    models = {"a": ["x1"], "b": ["x2", "x1"], "all": ["x1", "x2", "x3", "x4"], "c": ["x4", "x3"]}
    fits = grid.fit_together(rel, ["sid"], models)
    for name, use in models.items():
        one = choice.fit_mnl(None, ["sid"], use, rel=rel)
        assert fits[name].converged and fits[name].names == use
        assert np.allclose(fits[name].theta, one.theta, atol=1e-6) and fits[name].point.ll == pytest.approx(one.point.ll)
        assert np.allclose(fits[name].std_errors(), one.std_errors(), rtol=1e-6)
        assert (fits[name].n_obs, fits[name].null_ll) == (one.n_obs, pytest.approx(one.null_ll))


def test_jobs_do_not_grow_with_models(spark, monkeypatch):
    df = spark.createDataFrame(choices(n=60))
    rel = kernels.relative_design(df, ["sid"], ["x1", "x2"], "chosen").cache()
    calls = []
    plain = grid.Design.points
    monkeypatch.setattr(grid.Design, "points", lambda self, betas: calls.append(len(betas)) or plain(self, betas))
    grid.fit_together(rel, ["sid"], {f"m{i}": ["x1", "x2"][:1 + i % 2] for i in range(30)})
    assert len(calls) < 10 and calls[0] == 30


def test_grid_of_model_grid(spark):
    df = spark.createDataFrame(choices(n=60)).withColumn("buy", (F.col("alt") > 0).cast("double"))
    scores = df.select("id").distinct().select("id", F.sin("id").alias("A"), F.cos("id").alias("B"))
    models = pipeline.grid_models(shape.model_grid(spark.range(1), ["A", "B"], ["x1"]), {"A": "buy", "B": "buy"})
    assert len(models) == 1 + 2 * 2 + 4
    out = pipeline.run_model_grid(df, scores, "id", ["sid"], ["x1", "x2"], models).collect()
    assert {r.run for r in out} == set(models) and all(r.converged for r in out)
    ll = {r.run: r.estimate for r in out if r.parameter == "LL"}
    assert all(ll[m] >= ll["base"] - 1e-9 for m in models)
    with pytest.raises(ValueError, match="more than 3"):
        pipeline.grid_models(shape.model_grid(spark.range(1), ["A", "B"], ["x1"]), {"A": "buy", "B": "buy"}, limit=3)


def test_logit_of_many_attributes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = choices(n=120)
    for i in range(12):
        pdf[f"w{i}"] = rng.normal(size=len(pdf))
    attrs = ["x1", "x2", *[f"w{i}" for i in range(12)]]
    df = spark.createDataFrame(pdf)
    wide = choice.fit_mnl(df, ["sid"], attrs, key="id", robust=True)
    monkeypatch.setattr(kernels, "FEW", 100)
    sums = choice.fit_mnl(df, ["sid"], attrs, key="id", robust=True)
    assert wide.converged and np.allclose(wide.theta, sums.theta, atol=1e-6) and np.allclose(wide.std_errors(), sums.std_errors(), rtol=1e-5)
    assert (wide.n_obs, wide.point.ll, wide.null_ll) == pytest.approx((sums.n_obs, sums.point.ll, sums.null_ll))
