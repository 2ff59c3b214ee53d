"""Small Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PROB_FLOOR = 1e-10


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return a / F.when(b != 0, b)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clip_prob(p: Column, floor: float = PROB_FLOOR) -> Column:
    return clip(p, floor, 1 - floor)


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` holds; 0 (not NULL) for an empty group."""
    return F.count(F.when(cond, 1))


def signif_stars(p: Column, levels=((0.001, "***"), (0.01, "**"), (0.05, "*"))) -> Column:
    """Significance mark; NULL and NaN give ''."""
    out = F.when(p.isNull() | F.isnan(p), "")
    for cut, mark in levels:
        out = out.when(p < cut, mark)
    return out.otherwise("")


STARS_WITH_DOT = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."))


def to_long(df, ids: list[str], values: list[str], name: str, value: str):
    """Unpivot with a common double value column."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        ids, values, name, value)


def hash_unit(*parts: Column) -> Column:
    """Uniform in (0, 1) from the md5 of the parts: the same on every engine and partitioning."""
    digest = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16 ** 13)
