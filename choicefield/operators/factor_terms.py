"""Utility terms of latent factors given as rows: a specification table is compiled to Columns at run time.

A row is (factor, role, name, value). Roles: ``item`` (the loading of an item), ``direct`` (coefficient of the score, name
ignored), ``interaction`` (coefficient of score x attribute), ``weight`` (of the whole term; 1 without a row).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shape import attach_scores
from .utility import factor_utility, loading_score, total_utility

ROLES = ("item", "direct", "interaction", "weight")
MOST = 10_000  # rows of a specification; more make an error


@dataclass
class FactorTerm:
    loadings: dict[str, float] = field(default_factory=dict)
    direct: float = 0.0
    interactions: dict[str, float] = field(default_factory=dict)
    weight: float = 1.0

    def score(self) -> Column:
        return loading_score(self.loadings)

    def utility(self, score: str) -> Column:
        return factor_utility(score, self.direct, self.interactions, self.weight)


def compile_terms(spec: DataFrame) -> dict[str, FactorTerm]:
    """The terms of a specification (factor, role, name, value), by factor in name order.

    A table of more than ``MOST`` rows, an unknown role, a missing or infinite value, a factor without a name or without items, and two
    rows for the same thing are errors."""
    rows = spec.select("factor", "role", "name", F.col("value").cast("double").alias("value")).orderBy("factor", "role", "name").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a factor specification has at most {MOST} rows")
    terms: dict[str, FactorTerm] = {}
    seen = set()
    for r in rows:
        if r.factor is None or r.role not in ROLES or r.value is None or not math.isfinite(r.value):
            raise ValueError(f"bad row of a factor specification: {r.asDict()}")
        what = (r.factor, r.role, r.name if r.role in ("item", "interaction") else None)
        if what in seen or r.role in ("item", "interaction") and r.name is None:
            raise ValueError(f"two rows or no name for {what}")
        seen.add(what)
        term = terms.setdefault(r.factor, FactorTerm())
        if r.role == "item":
            term.loadings[r.name] = r.value
        elif r.role == "interaction":
            term.interactions[r.name] = r.value
        else:
            setattr(term, r.role, r.value)
    empty = [f for f, t in terms.items() if not t.loadings]
    if empty:
        raise ValueError(f"factors without items: {empty}")
    return terms


def integrate_factors(long: DataFrame, individuals: DataFrame, key: str, spec: DataFrame, total: str = "factor_utility") -> DataFrame:
    """Choice rows with the scores of every factor (column of its name), its term ``u_<factor>`` and their sum.

    Scores are formed once per individual and joined by key; individuals without answers have no score and terms of 0."""
    terms = compile_terms(spec)
    scores = individuals.select(key, *[t.score().alias(f) for f, t in terms.items()])
    rows = attach_scores(long, scores, key, list(terms)).withColumns({f"u_{f}": t.utility(f) for f, t in terms.items()})
    return rows.withColumn(total, total_utility([f"u_{f}" for f in terms]) if terms else F.lit(0.0))


def factor_summary(scored: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, n, mean, sd, min, max) of score columns."""
    from .stats import inline
    one = scored.agg(*[e for f in factors for e in (F.count(f).alias(f"n_{f}"), F.avg(f).alias(f"mean_{f}"), F.stddev_samp(f).alias(f"sd_{f}"),
                                                  F.min(f).cast("double").alias(f"min_{f}"), F.max(f).cast("double").alias(f"max_{f}"))])
    return inline(one, [], [{"factor": F.lit(f), **{k: F.col(f"{k}_{f}") for k in ("n", "mean", "sd", "min", "max")}} for f in factors])
