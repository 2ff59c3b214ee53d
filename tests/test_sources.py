import json

import pytest
from pyspark.sql import functions as F

from choicefield.operators import checks, encode, iterations, shape
from choicefield.sources import logs, runs, tables

LOG = """2025-11-23 10:00:00 start
2025-11-23 10:01:00 - [Major Iteration #1 완료]
  최종 LL: -7581.25
  Line Search: 3회 함수 호출 - [OK]
  함수 호출: 4회 (누적)
  그래디언트 호출: 2회 (누적)
  ftol = N/A
  gtol = 1.5e-02
2025-11-23 10:03:30 - [Major Iteration #2 완료]
  최종 LL: -7570.5
  Line Search: 10회 함수 호출 - [FAIL]
  함수 호출: 14회 (누적)
  그래디언트 호출: 3회 (누적)
  ftol = 1.4e-03
  gtol = 1e-03
"""


def test_csv_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "hc.csv"
    p.write_bytes("﻿no,q6,q7\n1,4,NaN\n2,x,3.5\n".encode())
    rows = tables.read_responses(spark, str(p), {"no": "bigint", "q6": "int", "q7": "double"}).orderBy("no").collect()
    assert [tuple(r) for r in rows] == [(1, 4, None), (2, None, 3.5)]
    with pytest.raises(ValueError):
        tables.read_responses(spark, str(p), {"q9": "int"})


def test_missing_factor_table_is_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("no,q1\n1,5\n")
    with pytest.warns(UserWarning):
        df = tables.read_factor_tables(spark, {"a": (str(tmp_path / "a.csv"), "no", ["q1"]), "b": (str(tmp_path / "b.csv"), "no", ["q2"])})
    assert [tuple(r) for r in df.collect()] == [(1, "a", "q1", 5.0)]


def test_item_metadata(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"scale_range": {"min": 1, "max": 5}, "reverse_items": {"pb": {"items": ["q12", "q13"], "reverse_items": ["q13"]}}}))
    dim = tables.read_item_metadata(spark, str(p))
    assert {(r.factor, r.item, r.is_reversed, r.scale_max) for r in dim.collect()} == {("pb", "q12", False, 5), ("pb", "q13", True, 5)}
    assert encode.reverse_code_summary(dim).first().n_reversed == 1


def test_log_file(spark, tmp_path):
    p = tmp_path / "est.log"
    p.write_text(LOG)
    rows = logs.read_estimation_log(spark, str(p)).orderBy("iteration").collect()
    assert [(r.iteration, r.ll, r.line_search_calls, r.status, r.func_calls, r.grad_calls, r.ftol, r.gtol) for r in rows] == [
        (1, -7581.25, 3, "OK", 4, 2, None, 0.015), (2, -7570.5, 10, "FAIL", 14, 3, 0.0014, 0.001)]
    stamps = logs.iteration_stamps(logs.read_blocks(spark, str(p), logs.ITERATION_MARK), ["run"]).orderBy("iteration").collect()
    assert [str(r.ts) for r in stamps] == ["2025-11-23 10:01:00", "2025-11-23 10:03:30"]


def test_run_names_round_trip(spark):
    df = spark.createDataFrame([("st2_HC-PB_PB-PI1_NK_PI_int_PIxhl_NKxpr2_results.csv",), ("st2_HC-PB1_base2_results.csv",), ("other.csv",)], "run string")
    a, b, c = runs.parse_run_name(df, "run").collect()
    assert a.paths == ["HC->PB", "PB->PI"] and a.main_lvs == ["nutrition_knowledge", "purchase_intention"]
    assert a.interactions == ["nutrition_knowledge:price", "purchase_intention:health_label"]
    assert b.main_lvs == [] and b.interactions == [] and c.paths is None


def test_wide_to_long_has_one_choice_per_set(spark):
    design = spark.createDataFrame([(s, a, 1000.0 * a) for s in (1, 2) for a in (1, 2, 3)], "sid bigint, alt bigint, price double")
    wide = spark.createDataFrame([(7, 1, 3), (8, 2, None)], "id bigint, q21 int, q22 int")
    long = shape.wide_to_long_choice(wide, "id", {"q21": 1, "q22": 2}, design)
    assert long.count() == 12
    found = {r.rule: r.n_bad for r in checks.validate_long_choice(long, "id", "sid", "alt", "chosen").collect()}
    assert found == {"one_choice_per_set": 1, "alternative_repeated": 0, "choices_per_id": 1}


def test_zscore_of_constant_column_is_centred(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, x double")
    assert [tuple(r) for r in encode.zscore_pop(df, ["c", "x"]).select("c_z", "x_z").orderBy("x_z").collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_early_stop_counts_gains_that_add_up(spark):
    # rises of .6 tol: every second one is a gain against the best value at the last gain
    ll = [0.0, 0.6, 1.2, 1.8, 2.4, 2.4, 2.4, 2.4]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(ll)], "run int, i int, ll double")
    row = iterations.early_stop_point(df, "run", ["i"], "ll", patience=3, tol=1.0).first()

    def by_hand(patience=3, tol=1.0):
        best, wait = -1e9, 0
        for k, v in enumerate(ll, 1):
            best, wait = (v, 0) if v > best + tol else (best, wait + 1)
            if wait >= patience:
                return k, best
    assert (row.stop_step, row.best_ll) == by_hand()


def test_reassign_uses_gaps_then_new_ids(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (3, 3), (3, 4)], "id bigint, o bigint")
    out = sorted((r.o, r.new_id) for r in checks.reassign_duplicate_ids(df, "id", ["o"]).collect())
    assert out == [(0, 1), (1, 2), (2, 4), (3, 3), (4, 5)]


def test_duplicate_agreement_treats_null_as_value(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1.0), (2, None), (3, 1.0), (3, 1.0)], "k int, a double")
    out = {r.k: r.same_a for r in checks.duplicate_agreement(df, ["k"], ["a"]).collect()}
    assert out == {1: True, 2: False, 3: True}
    assert checks.missing_profile(spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "a double")).first().n_missing == 2
    assert iterations.alt_index(df.withColumn("i", F.monotonically_increasing_id()), ["k"], ["i"]).agg(F.max("alt_index")).first()[0] == 1
