"""Cases that only show at scale: hot groups, large exponents, large degrees of freedom, files with different headers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicefield.functions import groups, tails
from choicefield.operators import kernels
from choicefield.sources import runs


def test_hot_group_is_found_among_many_keys(spark):
    df = spark.range(3_000_000).select(F.when(F.col("id") < 400, -1).otherwise(F.col("id") % 1_000_000).alias("k"))
    assert groups.has_hot_group(df, ["k"], 100)
    assert not groups.has_hot_group(df, ["k"], 400)


@pytest.mark.parametrize("keys", [["k"], []])
def test_scan_of_a_hot_group_with_a_tied_first_order_column(spark, keys, monkeypatch):
    monkeypatch.setattr(groups, "RANGES", 64)
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).alias("k"), F.lit(1).alias("o"),
                                  F.col("id").alias("i"), (F.col("id") * 7 % 101).alias("v"))
    both = [groups.ordered_scan(df, keys, ["o", "-i"], number="n", lag={"l": "v"}, run_sum={"s": "v"}, run_max={"m": "v"}, split=split, hot_rows=200)
            .orderBy("i").collect() for split in (True, False)]
    assert both[0] == both[1]
    pieces = groups._into_ranges(df, keys, groups._parse(df, ["o", "-i"])[0], 200).filter("__range >= 0").groupBy("__range").count()
    assert pieces.count() > 30


def test_large_exponents(spark):
    for x in ([0.0, 750.0, 900.0], [0.0, 20000.0, 30000.0], [0.0, -750.0, 3.0], [0.0, 255.9, 256.1]):
        rel = spark.createDataFrame([(1, v) for v in x], "s int, d_a double")
        p = np.exp(np.array(x) - max(x))
        p /= p.sum()
        gradient = -(p @ x)
        assert kernels.mnl_gradient(rel, ["s"], {"a": 1.0}).first().gradient == pytest.approx(gradient, rel=1e-12)
        hessian = kernels.hessian_agg(rel, ["s"], {"a": 1.0}).first().value
        assert hessian == pytest.approx(gradient ** 2 - p @ np.array(x) ** 2, rel=1e-9, abs=1e-6)


def test_draws_do_not_repeat_and_have_any_number_of_dimensions(spark):
    at = spark.createDataFrame([(5,), (2 ** 40 + 5,), (2 ** 48 + 5,)], "i bigint").select(kernels.radical_inverse(F.col("i"), 2).alias("u")).collect()
    assert len({r.u for r in at}) == 3 and at[0].u == 0.625
    assert kernels.primes(20)[-1] == 71


def test_weights_reject_draws_that_are_not_finite(spark):
    df = spark.createDataFrame([(1, -3.0), (1, float("nan")), (1, -2.0), (1, float("-inf")), (2, float("nan")), (2, None)], "k int, ll double")
    rows = kernels.importance_weights(df, "k").collect()
    first = sorted(r.w for r in rows if r.k == 1)
    assert first[:2] == [0, 0] and first[2:] == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    assert [r.w for r in rows if r.k == 2] == [0, 0]


def test_t_law_at_large_degrees_of_freedom():
    for d in (1e10, 1e12, 1e14):
        for t in (0.5, 2.0, 5.0, 30.0):
            assert tails.t_tail(t, d) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6)
    for t in (0.5, 2.0, 8.0):
        assert tails.t_tail(t, 1e6) == pytest.approx(tails.t_tail(t, 1e6 + 1), rel=1e-4)
    for t in (0.1, 1.0, 30.0):  # closed form at 2 degrees of freedom
        assert tails.t_tail(t, 2.0) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)


def test_result_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a_results.csv").write_text("section,parameter,estimate\nParameters,beta,0.1\n")
    (tmp_path / "b_results.csv").write_text("section,estimate,std_error,parameter\nParameters,0.2,2.5,gamma\n")
    rows = {r.run: r for r in runs.read_result_runs(spark, str(tmp_path)).collect()}
    assert (rows["a"].parameter, rows["a"].estimate, rows["a"].std_error) == ("beta", "0.1", None)
    assert (rows["b"].parameter, rows["b"].estimate, rows["b"].std_error) == ("gamma", "0.2", "2.5")
