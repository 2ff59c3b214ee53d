"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from choicefield.plans import load  # noqa: E402
from choicefield.session import local_session  # noqa: E402

HEADLINE = ["flagship", "zscore_pop", "integrate_left", "distribution_profile", "auc", "corr_full", "reliability_table",
            "softmax_prob", "mnl_loglik", "probit_loglik", "mnl_gradient", "opg_matrix", "hessian_agg", "halton_draws",
            "simulated_loglik", "bootstrap_means", "bootstrap_ci", "mediation_sweep", "early_stop_point", "fit_mnl", "sem_fit", "fit_iclv_simultaneous"]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.time()
        queries[name].run(spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": path.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
