"""Iteration traces of estimation runs: changes, timing, convergence, frozen parameters, forecasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import first_n, has_hot_group, numbered, ordered_scan
from ..functions.scalars import count_if, safe_div
from ..session import stored


def alt_index(long: DataFrame, keys: list[str], order: list[str], name: str = "alt_index") -> DataFrame:
    """Position of a row inside its set, from 0; sets may have any size."""
    return numbered(long, keys, order, "__rn").withColumn(name, F.col("__rn") - 1).drop("__rn")


def set_id(long: DataFrame, keys: list[str], name: str = "set_index") -> DataFrame:
    """Dense id (from 1) of each (id, set) along ``keys``; the first key is numeric."""
    sets = numbered(long.select(*keys).distinct(), [], keys, name, split=has_hot_group(long, []))
    return long.join(sets, keys)


def iteration_deltas(trace: DataFrame, run: str, order: list[str], ll: str) -> DataFrame:
    d = ordered_scan(trace, [run], order, lag={"prev_ll": ll})
    change = F.col(ll) - F.col("prev_ll")
    return d.withColumns({"change": change, "change_pct": 100 * safe_div(change, F.abs("prev_ll")), "improved": change > 0})


def iteration_timing(trace: DataFrame, run: str, order: list[str], ts: str) -> DataFrame:
    """Seconds since the previous iteration and since the first one."""
    t = trace.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    t = ordered_scan(t, [run], order, lag={"__prev": "__s"}).withColumn("seconds", F.col("__s") - F.col("__prev"))
    start = t.groupBy(run).agg(F.min("__s").alias("__start"))
    return t.join(start, run).withColumn("elapsed", F.col("__s") - F.col("__start")).drop("__s", "__prev", "__start")


def timing_summary(timed: DataFrame, run: str) -> DataFrame:
    s = F.col("seconds")
    return timed.groupBy(run).agg(F.count(F.lit(1)).alias("n_iterations"), F.avg(s).alias("mean_seconds"),
                                  F.max(s).alias("max_seconds"), F.min(s).alias("min_seconds"), F.max("elapsed").alias("total_seconds"))


def tail_stats(trace: DataFrame, run: str, order: list[str], columns: list[str], n: int = 10) -> DataFrame:
    """sd over the last ``n`` rows of a run; ``order`` is given newest first."""
    tail = first_n(trace, [run], order, n)
    return tail.groupBy(run).agg(F.count(F.lit(1)).alias("n"), *[F.stddev_samp(c).alias(f"{c}_sd") for c in columns])


def frozen_params(trace: DataFrame, keys: list[str], iteration: str, value: str, gradient: str) -> DataFrame:
    """Parameters whose gradient or value does not move over the iterations; % change from first to last."""
    out = trace.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(gradient).alias("gradient_sd"), F.stddev_pop(value).alias("value_sd"),
        F.min_by(value, iteration).alias("first_value"), F.max_by(value, iteration).alias("last_value"))
    return out.withColumns({"gradient_frozen": F.col("gradient_sd") < 1e-10, "gradient_nearly_frozen": F.col("gradient_sd") < 1e-6,
                            "value_frozen": F.col("value_sd") < 1e-10,
                            "percent_change": 100 * safe_div(F.col("last_value") - F.col("first_value"), F.abs("first_value"))})


def convergence_status(trace: DataFrame, keys: list[str], status: str, ftol: str, gtol: str, limit: float = 1e-3) -> DataFrame:
    return trace.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in ("OK", "WARN", "FAIL")],
        count_if(F.col(ftol) <= limit).alias("n_ftol"), F.count(ftol).alias("n_with_ftol"), count_if(F.col(gtol) <= limit).alias("n_gtol"))


def _late_gains(tol: float):
    """Rows (run, seg, step, v, base), sorted, v rising within (run, seg) -> the (run, step) where v exceeds the best value by more
    than ``tol``, which then moves there. Only the best value of the open stretch is carried from batch to batch."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, best = None, 0.0
        for batch in batches:
            seg, v, base, runs = (batch.column(c) for c in ("seg", "v", "base", "run"))
            seg, v, base = seg.to_numpy(), v.to_numpy(), base.to_numpy()
            other = (pc.fill_null(pc.not_equal(runs[1:], runs[:-1]), True).to_numpy(zero_copy_only=False) if len(v) > 1 else np.empty(0, bool)) | (np.diff(seg) != 0)
            starts = [0, *(np.flatnonzero(other) + 1).tolist(), len(v)]
            hits = []
            for a, b in zip(starts, starts[1:]):
                if b == a:
                    continue
                if here != (runs[a].as_py(), seg[a]):
                    here, best = (runs[a].as_py(), seg[a]), base[a]
                i = a + int(np.searchsorted(v[a:b], best + tol, "right"))
                while i < b:
                    hits.append(i)
                    best = v[i]
                    i = a + int(np.searchsorted(v[a:b], best + tol, "right"))
            at = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays([runs.take(at), batch.column("step").cast(pa.int64()).take(at)], ["run", "step"])
    return fold


def early_stop_point(trace: DataFrame, run: str, order: list[str], ll: str, patience: int = 5, tol: float = 1e-6) -> DataFrame:
    """Per run the evaluation at which ``patience`` evaluations in a row brought no gain above ``tol``, or NULLs.

    The rule's best value moves only on a gain above ``tol``. A row above the running maximum by more than
    ``tol`` is a gain for sure and sets the best value. Rows that raise the maximum by less can add up to a
    gain; only those are folded in order, streaming, within the stretch that follows a sure gain.
    """
    split = has_hot_group(trace, [run])
    step = stored(ordered_scan(trace, [run], order, number="step", max_before={"__prev": ll}, split=split), "steps")
    sure = F.col("__prev").isNull() | (F.col(ll) > F.col("__prev") + tol)
    rows = stored(ordered_scan(step.withColumn("__sure", F.when(sure, F.col("step"))), [run], ["step"],
                               run_max={"__seg": "__sure"}, split=split), "gains")

    base = rows.filter(F.col("__sure").isNotNull()).select(run, "__seg", F.col(ll).alias("__base"))
    creeping = (rows.filter(F.col("__sure").isNull() & (F.col(ll) > F.col("__prev"))).join(base, [run, "__seg"])
                .select(F.col(run).alias("run"), F.col("__seg").alias("seg"), "step", F.col(ll).cast("double").alias("v"), F.col("__base").cast("double").alias("base"))
                .repartition("run", "seg").sortWithinPartitions("run", "seg", "step"))
    late = (creeping.mapInArrow(_late_gains(tol), f"run {rows.schema[run].dataType.simpleString()}, step bigint")
            .select(F.col("run").alias(run), "step", F.lit(True).alias("__late")))
    marked = (rows.join(late, [run, "step"], "left")
              .withColumn("__gain", F.when(F.col("__sure").isNotNull() | F.col("__late").isNotNull(), F.col("step")))
              .withColumn("__gain_ll", F.when(F.col("__gain").isNotNull(), F.col(ll))))
    last = ordered_scan(marked, [run], ["step"], run_max={"__last": "__gain", "best_ll": "__gain_ll"}, split=split)
    waiting = last.withColumn("waited", F.col("step") - F.col("__last"))
    stop = waiting.filter(F.col("waited") >= patience).groupBy(run).agg(F.min("step").alias("stop_step"),
                                                                        F.min_by("best_ll", "step").alias("best_ll"))
    total = trace.groupBy(run).agg(F.count(F.lit(1)).alias("n_evaluations"))
    return total.join(stop, run, "left").withColumn("stopped", F.col("stop_step").isNotNull())


def convergence_forecast(trace: DataFrame, keys: list[str], order: list[str], value: str,
                         ahead: int = 10, horizon: int = 50) -> DataFrame:
    """Projections from the last three values of each trace: linear, geometric decay, mean of the last two, and a
    confidence 1/(1 + 10 |mean change|). ``order`` is given newest first; a trace with one value has only ``last``."""
    last3 = first_n(trace, keys, order, 3, "__rn")
    v = last3.groupBy(*keys).agg(*[F.max(F.when(F.col("__rn") == i, F.col(value))).alias(f"v{i}") for i in (1, 2, 3)])
    d1, d2 = F.col("v1") - F.col("v2"), F.col("v2") - F.col("v3")
    mean = F.coalesce((d1 + d2) / 2, d1)
    ratio = F.when(d2.isNull() | (F.abs(d2) <= 1e-6), 0.9).otherwise(F.least(F.greatest(d1 / F.when(d2 != 0, d2), F.lit(0.0)), F.lit(1.0)))
    v = v.withColumns({"change": mean, "ratio": ratio})
    r = F.col("ratio")
    series = F.when(F.abs(1 - r) > 1e-6, (1 - F.pow(r, F.lit(horizon))) / F.when(r != 1, 1 - r)).otherwise(float(horizon))
    decay = F.when(F.abs("change") < 1e-6, F.col("v1")).otherwise(F.col("v1") + F.col("change") * series)
    return v.select(*keys, F.col("v1").alias("last"), (F.col("v1") + F.col("change") * ahead).alias("linear"),
                    decay.alias("decay"), ((F.col("v1") + F.col("v2")) / 2).alias("average"),
                    (1 / (1 + F.abs("change") * 10)).alias("confidence"))


def gradient_stats_by_group(trace: DataFrame, iteration: list[str], group: str, gradient: str, base: str, others: list[str]) -> DataFrame:
    """mean / max / min |gradient| per iteration and model part, and each part's mean over the base part's."""
    g = F.abs(gradient)
    stats = trace.groupBy(*iteration, group).agg(F.count(F.lit(1)).alias("n"), F.avg(g).alias("mean_abs"),
                                                 F.max(g).alias("max_abs"), F.min(g).alias("min_abs"))
    ratios = trace.groupBy(*iteration).agg(F.avg(F.when(F.col(group) == base, g)).alias("__base"),
                                           *[F.avg(F.when(F.col(group) == o, g)).alias(f"__{o}") for o in others])
    ratios = ratios.select(*iteration, *[safe_div(F.col(f"__{o}"), F.col("__base")).alias(f"{o}_over_{base}") for o in others])
    return stats.join(ratios, iteration)


def individual_gradient_profile(scores: DataFrame, columns: list[str], near: float = 0.001) -> DataFrame:
    from .stats import long_agg
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return long_agg(scores, columns, {"n": F.count, "mean": F.avg, "sd": F.stddev_samp,
                                      "near_zero": lambda c: share(F.abs(c) < near), "positive": lambda c: share(F.col(c) > 0),
                                      "negative": lambda c: share(F.col(c) < 0)}, label="parameter")
