"""A cross-section of the registered queries against their SQL (tools/check.py runs all of them)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICK = ["flagship", "split_factor_tables", "parse_run_name", "check_run_consistency", "reassign_duplicate_ids", "zscore_pop", "bin_tertile",
        "wide_to_long_choice", "integrate_left", "model_grid", "distribution_profile", "corr_full", "reliability_table", "htmt", "auc",
        "early_stop_point", "model_table", "softmax_prob", "ordered_probit_prob", "hessian_agg", "halton_draws", "simulated_loglik", "sobel",
        "bootstrap_individuals", "bootstrap_ci_bc", "modification_index"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"create view {n} as select * from '{SMALL}/{n}.parquet'")
    return con


def key(v):
    if v is None:
        return ""
    return repr(v) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(key(r[c]) for c in sorted(names)) for r in df.collect())
    want = sorted(tuple(key(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() == 3
