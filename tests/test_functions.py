import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicefield.functions import groups as g
from choicefield.functions.normal import norm_cdf, norm_ppf, two_sided_p, with_normals
from choicefield.functions.scalars import safe_div, signif_stars
from choicefield.functions.tails import chi2_sf, incomplete_beta, t_two_sided, upper_gamma


def test_norm_cdf_against_erfc(spark):
    xs = [-38.0, -9.0, -7.2, -3.1, -1.0, -1e-9, 0.0, 0.5, 2.0, 6.9, 7.3, 12.0, 40.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=2e-15)


def test_norm_ppf_inverts(spark):
    ps = [1e-12, 1e-5, 0.01, 0.075, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    rows = with_normals(df, {"z": F.col("p")}).select("p", "z", norm_ppf(F.col("p")).alias("y")).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-14) and r.y == r.z


def test_tails_known_values(spark):
    assert upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-12)
    assert upper_gamma(5.0, 18.307038053275146 / 2) == pytest.approx(0.05, abs=1e-12)
    assert incomplete_beta(5.0, 0.5, 10 / (10 + 2.2281388519649385 ** 2)) == pytest.approx(0.05, abs=1e-10)
    row = spark.sql("select 3.841458820694124D x, 1.0D d, 2.2281388519649385D t, 10.0D e, 1.959963984540054D z").select(
        chi2_sf("x", "d").alias("a"), t_two_sided("t", "e").alias("b"), two_sided_p(F.col("z")).alias("c")).first()
    assert row.a == pytest.approx(0.05) and row.b == pytest.approx(0.05) and row.c == pytest.approx(0.05)


def test_stars_and_safe_div(spark):
    df = spark.createDataFrame([(0.0001,), (0.005,), (0.04,), (0.5,), (None,), (float("nan"),)], "p double")
    assert [r[0] for r in df.select(signif_stars(F.col("p"))).collect()] == ["***", "**", "*", "", "", ""]
    assert spark.range(1).select(safe_div(F.lit(1.0), F.lit(0.0))).first()[0] is None


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(6000).selectExpr("id", "case when id % 3 = 0 then 7 else id % 40 end as k", "cast(hash(id) % 97 as double) as v").cache()


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["v", "id"], ["-v", "id"]])
def test_split_scan_equals_window(skewed, keys, order):
    want = dict(number="n", lag={"lg": "v"}, run_sum={"rs": "v"}, run_max={"rm": "v"}, max_before={"mb": "v"})
    plain = g.ordered_scan(skewed, keys, order, split=False, **want)
    split = g.ordered_scan(skewed, keys, order, hot_rows=500, **want)
    assert split.count() == 6000 and plain.exceptAll(split).isEmpty()


def test_split_group_values(skewed):
    agg = {"m": F.max("v"), "c": F.count("*")}
    assert g.has_hot_group(skewed, ["k"], 500) and not g.has_hot_group(skewed, ["k"], 5000)
    assert g.with_group_values(skewed, ["k"], agg, split=False).exceptAll(g.with_group_values(skewed, ["k"], agg, hot_rows=500)).isEmpty()


@pytest.mark.parametrize("hot", [None, 10])
def test_exact_quantiles(skewed, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(g, "HOT_ROWS", hot)
    probs = {"a": 0.025, "b": 0.5, "c": 0.99}
    v = np.array([r.v for r in skewed.select("v").collect()])
    row = g.exact_quantiles(skewed, [], "v", probs).first()
    assert [row[n] for n in probs] == pytest.approx([np.quantile(v, p) for p in probs.values()])
    by = {r.k: r for r in g.exact_quantiles(skewed, ["k"], "v", probs).collect()}
    seven = np.array([r.v for r in skewed.filter("k = 7").select("v").collect()])
    assert [by[7][n] for n in probs] == pytest.approx([np.quantile(seven, p) for p in probs.values()])


def test_first_n(skewed):
    out = g.first_n(skewed, ["k"], ["-v", "id"], 2)
    assert out.groupBy("k").count().agg(F.max("count")).first()[0] == 2
