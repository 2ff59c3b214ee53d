"""Faults that a review found: draws and bootstrap picks that look small to the optimizer, traces without their run, features cut short."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from choicefield.llm import secret_scan
from choicefield.operators import kernels, resample
from choicefield.plans import choice
from choicefield.plans.registry import Tables
from choicefield.sources import logs
from conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_generated_draws_are_not_broadcast(spark):
    """F1 to F4: the exploded draws are as small as their ids for the optimizer."""
    ids = spark.createDataFrame([(i, i) for i in range(4)], "id bigint, idx bigint")
    rel = spark.createDataFrame([(i, s, float(d)) for i in range(4) for s in range(2) for d in range(3)], "id bigint, sid bigint, d_p double")
    coefs = kernels.halton_draws(ids, "id", 8, 1).withColumn("b_p", F.col("z1"))
    out = kernels.draw_choice(rel, coefs, ["id"], ["sid"], ["p"], ["z1"])
    assert "Broadcast" not in _plan(out)
    rows = out.collect()
    assert len(rows) == 32
    for r in rows:
        assert abs(r.ll + 2 * np.log(sum(np.exp(r.z1 * d) for d in range(3)))) < 1e-9
    tables = Tables(spark, SMALL)
    draws = _plan(choice.draw_lls(tables))
    assert draws.count("Generate explode") == 1


def test_slots_are_spread_over_tasks(spark, monkeypatch):
    """F9 to F16: ids numbered in one task do not draw all their replicates there; the weights stay the same."""
    df = spark.range(500).select(F.col("id").alias("k"))
    whole = {(r.replicate, r.k): r.w for r in resample.bootstrap_individuals(df, "k", 6, 11).collect()}
    monkeypatch.setattr(resample, "SLOTS", 300)
    weights = resample.bootstrap_individuals(df, "k", 6, 11)
    assert weights.rdd.getNumPartitions() == 10 and "Broadcast" not in _plan(weights)
    assert {(r.replicate, r.k): r.w for r in weights.collect()} == whole
    assert sum(whole.values()) == 3000


def test_trace_rows_have_their_run(spark, tmp_path):
    """the query's rows are those of its SQL, run included; the reader tells iterations apart."""
    (tmp_path / "a.txt").write_text("".join(
        f"noise\n{logs.ITERATION_MARK}{i} 완료]\n  [  9] x : param=+1.0e+00, grad=1.0e+00\n{logs.TRACE_MARK}\n  [  0] b : param={i}.5e+00, grad=-2.5e-01\n" for i in (3, 4)))
    rows = logs.read_param_trace(spark, str(tmp_path), numbered=True).orderBy("iteration").collect()
    assert [(r.iteration, r.param_index, r.parameter, r.value, r.gradient) for r in rows] == [(3, 0, "b", 3.5, -0.25), (4, 0, "b", 4.5, -0.25)]
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SMALL}/events.parquet'")
    columns = ["run", "param_index", "parameter", "value", "gradient"]
    want = sorted(con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()['read_param_trace']})").fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in entry.queries()["read_param_trace"](spark, SMALL).collect())
    assert got == want and len({r[0] for r in got}) == len(got) / 2


def test_features_read_the_whole_value():
    """what stands behind the 512th character of a value counts."""
    corpus = secret_scan.Corpus(np.zeros((128, 128)), frozenset(["password"]))
    at = {n: i for i, n in enumerate(secret_scan.FEATURES)}
    value = "7" * 600 + "password" * 25
    f = secret_scan.features(value, 0, len(value), "", corpus)
    assert f[at["coverage"]] == 200 / 800 and f[at["longest_word"]] == 8 and f[at["length"]] == 800
