"""Stages that live in stored pipelines, factor terms from a specification table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from choicefield.estimators.stages import Component, FactorScorer, UtilityAggregator, ZScore
from choicefield.operators import factor_terms
from test_estimators import FACTORS, factor_data


def rows(n=300, seed=2):
    rng = np.random.default_rng(seed)
    pdf = factor_data(n).assign(x=rng.normal(size=n), z=rng.normal(size=n))
    pdf["chosen"] = (0.8 * pdf.x - 0.4 * pdf.x * pdf.z + rng.logistic(size=n) > 0).astype(int)
    return pdf


def stages():
    return [FactorScorer(FACTORS), ZScore(["A", "B"]), Component("price", ["x"]), Component("mixed", ["x", "x*z"], how="logit"), Component("taste", ["A_z"], how="correlation"),
            UtilityAggregator({"price": 1.0}).with_component("mixed", 0.5).with_component("taste").with_component("gone").without_component("gone")]


def test_pipelines_are_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame(rows())
    pipeline = Pipeline(stages=stages())
    model = pipeline.fit(df)
    out = model.transform(df)
    pipeline.write().overwrite().save(f"{tmp_path}/plan")
    model.write().overwrite().save(f"{tmp_path}/fitted")
    fresh = spark.newSession()
    again = PipelineModel.load(f"{tmp_path}/fitted").transform(fresh.createDataFrame(rows()))
    refit = Pipeline.load(f"{tmp_path}/plan").fit(df).transform(df)
    cols = ["A", "B", "A_z", "price", "mixed", "taste", "total_utility"]
    want = out.orderBy("id").select(*cols).toPandas()
    for other in (again, refit):
        assert np.allclose(other.orderBy("id").select(*cols).toPandas(), want)
    assert np.allclose(want.total_utility, want.price + 0.5 * want.mixed + want.taste)


def test_components_learn_their_coefficients(spark):
    pdf = rows(2000)
    df = spark.createDataFrame(pdf)
    slope = Component("price", ["x", "x*z"]).fit(df).coefficients
    assert slope["x"] == pytest.approx(np.polyfit(pdf.x, pdf.chosen, 1)[0]) and slope["x*z"] == pytest.approx(np.polyfit(pdf.x * pdf.z, pdf.chosen, 1)[0])
    assert Component("price", ["x"], how="correlation").fit(df).coefficients["x"] == pytest.approx(np.corrcoef(pdf.x, pdf.chosen)[0, 1])
    both = Component("price", ["x", "x*z"], how="logit").fit(df).coefficients
    assert both["x"] == pytest.approx(0.8, abs=0.2) and both["x*z"] == pytest.approx(-0.4, abs=0.2)
    none = Component("price", ["x"]).fit(df.filter("false"))
    assert none.coefficients == {"x": 0.0}
    missing = Component("price", ["x"]).fit(df).transform(df.limit(1).withColumn("x", F.lit(None).cast("double"))).first()
    assert missing.price == 0.0
    with pytest.raises(ValueError, match="unknown way"):
        Component("price", ["x"], how="guess")
    with pytest.raises(ValueError, match="no component"):
        UtilityAggregator({"a": 1.0}).without_component("b")


SPEC = "factor string, role string, name string, value double"


def test_terms_from_rows(spark):
    spec = spark.createDataFrame([("A", "item", "a1", 1.0), ("A", "item", "a2", 0.5), ("A", "direct", None, 0.3), ("A", "interaction", "x", -0.2), ("A", "weight", None, 2.0),
                                  ("B", "item", "b1", 1.0)], SPEC)
    pdf = rows(40)
    pdf.loc[0, ["a1", "a2"]] = None
    who = spark.createDataFrame(pdf).select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("a1", "a2", "b1")])
    long = spark.createDataFrame(pd.DataFrame({"id": np.repeat(pdf.id, 2), "x": np.tile([0.5, -1.0], len(pdf))}))
    got = factor_terms.integrate_factors(long, who, "id", spec).toPandas().sort_values(["id", "x"]).reset_index(drop=True)
    score = ((pdf.a1 + 0.5 * pdf.a2) / 1.25)[got.id].to_numpy()
    assert np.allclose(got.A[2:], score[2:]) and got.A[:2].isna().all() and (got.u_A[:2] == 0).all()
    assert np.allclose(got.u_A[2:], 2 * (0.3 * score[2:] - 0.2 * score[2:] * got.x[2:])) and (got.u_B == 0).all()
    assert np.allclose(got.factor_utility, got.u_A)
    summary = {r.factor: r for r in factor_terms.factor_summary(who.select(F.col("b1").alias("B"), (F.col("a1") * 1).alias("A")), ["A", "B"]).collect()}
    assert summary["A"].n == 39 and summary["B"].mean == pytest.approx(pdf.b1.mean())


@pytest.mark.parametrize("row,match", [(("A", "other", "a1", 1.0), "bad row"), (("A", "item", "a1", 2.0), "two rows"), (("A", "item", "a3", float("inf")), "bad row"),
                                       (("B", "direct", None, 1.0), "without items"), ((None, "item", "a3", 1.0), "bad row"), (("A", "item", None, 1.0), "no name")])
def test_bad_specifications(spark, row, match):
    with pytest.raises(ValueError, match=match):
        factor_terms.compile_terms(spark.createDataFrame([("A", "item", "a1", 1.0), row], SPEC))


def test_an_empty_specification(spark):
    out = factor_terms.integrate_factors(spark.createDataFrame([(1, 2.0)], "id long, x double"), spark.createDataFrame([(1, 2.0)], "id long, a1 double"), "id", spark.createDataFrame([], SPEC))
    assert out.first().factor_utility == 0.0
