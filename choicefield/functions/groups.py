"""Ordered and grouped primitives that stay spread out when one group is huge.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. The helpers here count the groups
exactly first (a partially combined aggregate: a row per key and task). If none exceeds ``HOT_ROWS`` rows, they are the
plain window. If one does, it is cut:

* ``with_group_values`` - group aggregates on each row; the totals of hot groups come from a partially
  combined aggregate instead of the window;
* ``ordered_scan`` - row number, lag, running sum and running maximum; hot groups are cut into order
  ranges, and each range starts from the totals of the ranges before it;
* ``exact_quantiles`` - linear-interpolated quantiles from running value counts.

Both ways give the same values. Totals and ranges of hot groups are joined without a broadcast hint, so their number
may grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

HOT_ROWS = 5_000_000
RANGES = 1024  # at most; their cuts are sampled, and the driver gets about 300 rows a range
RANGE_ROWS = 1 << 18


def has_hot_group(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> bool:
    """Does any group exceed ``hot_rows`` rows? An exact count; what reaches the driver is one number."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if not keys:
        return df.count() > hot_rows
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > hot_rows


def _hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") > hot_rows).select(*keys))


def with_group_values(df: DataFrame, keys: list[str], values: dict[str, Column],
                      split: bool | None = None, hot_rows: int | None = None) -> DataFrame:
    """Each row with the aggregates of its group (``values``: name -> aggregate).

    ``split``: whether some group is hot; None counts the groups, which costs a pass over the key columns.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if not (has_hot_group(df, keys, hot_rows) if split is None else split):
        w = Window.partitionBy(*keys)
        return df.select("*", *[v.over(w).alias(n) for n, v in values.items()])
    tmp = {name: f"__t_{name}" for name in values}
    totals = (df.groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("__n"), *[v.alias(tmp[n]) for n, v in values.items()])
              .filter(F.col("__n") > hot_rows))
    hot = F.col("__n").isNotNull()
    salt = F.when(hot, F.pmod(F.xxhash64(*df.columns), F.lit(RANGES))).otherwise(0)
    joined = df.join(totals, keys, "left").withColumn("__salt", salt)
    w = Window.partitionBy(*keys, "__salt")
    return joined.select(
        *df.columns,
        *[F.when(hot, F.col(tmp[n])).otherwise(v.over(w)).alias(n) for n, v in values.items()])


def _parse(df: DataFrame, order: list[str]):
    cols = [o.lstrip("-") for o in order]
    sort = [F.col(c).desc() if o.startswith("-") else F.col(c).asc() for o, c in zip(order, cols)]
    rank = F.struct(*[(-F.col(c) if o.startswith("-") else F.col(c)).alias(f"o{i}")
                      for i, (o, c) in enumerate(zip(order, cols))])
    return sort, rank


def _into_ranges(df: DataFrame, keys: list[str], sort: list[Column], hot_rows: int, rows: int | None = None) -> DataFrame:
    """Adds ``__range``: -1 for rows of small groups; the others are cut into ranges along the whole order, ties in its
    first columns included, and numbered along it. Written once, as cuts are sampled."""
    ranges = RANGES if rows is None else min(RANGES, max(2, -(-rows // RANGE_ROWS)))

    def placed(hot: DataFrame) -> DataFrame:
        ranged = hot.repartitionByRange(ranges, *keys, *sort).withColumn("__range", F.spark_partition_id())
        return stored(ranged, "ranges")

    if not keys:
        return placed(df)
    hot_keys = _hot_keys(df, keys, hot_rows)
    return placed(df.join(hot_keys, keys, "left_semi")).unionByName(df.join(hot_keys, keys, "left_anti").withColumn("__range", F.lit(-1)))


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], *, number: str | None = None,
                 lag: dict[str, str] | None = None, run_sum: dict[str, str] | None = None,
                 run_max: dict[str, str] | None = None, max_before: dict[str, str] | None = None,
                 split: bool | None = None, hot_rows: int | None = None, rows: int | None = None) -> DataFrame:
    """Row number / lag / running sum / running max (up to, or strictly before, the row) within ``keys``.

    ``order`` names non-null columns ("-x" = descending) and must be a total order; every descending one is a number.
    ``rows``: how many rows there are at most, if known; a hot table is then cut into ranges of about ``RANGE_ROWS``.
    """
    lag, run_sum, run_max, max_before = lag or {}, run_sum or {}, run_max or {}, max_before or {}
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    split = has_hot_group(df, keys, hot_rows) if split is None else split
    sort, rank = _parse(df, order)
    groups = list(keys)
    if split:
        groups.append("__range")
        ranged = _into_ranges(df, keys, sort, hot_rows, rows)
    else:
        ranged = df
    here = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*sort)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    before = here.rowsBetween(Window.unboundedPreceding, -1)

    if split:
        along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range")
        prior = along.rowsBetween(Window.unboundedPreceding, -1)
        parts, carry = [F.count(F.lit(1)).alias("p_n")], [F.sum("p_n").over(prior).alias("__c_n")]
        for out, c in lag.items():
            parts.append(F.max_by(F.struct(F.col(c).alias("v")), rank).alias(f"p_{out}"))
            carry.append(F.lag(f"p_{out}").over(along)["v"].alias(f"__c_{out}"))
        for how, items in ((F.sum, run_sum), (F.max, run_max), (F.max, max_before)):
            for out, c in items.items():
                parts.append(how(c).alias(f"p_{out}"))
                carry.append(how(f"p_{out}").over(prior).alias(f"__c_{out}"))
        ranges = ranged.filter("__range >= 0").groupBy(*groups).agg(*parts).select(*groups, *carry)
        ranged = ranged.join(ranges, groups, "left")

    def carried(value: Column, out: str, join) -> Column:
        return join(value, F.col(f"__c_{out}")) if split else value

    def plus(a: Column, b: Column) -> Column:
        return F.coalesce(a + b, a, b)
    out_cols = []
    if number:
        out_cols.append(carried(F.row_number().over(here), "n", plus).cast("bigint").alias(number))
    for out, c in lag.items():
        value = F.lag(c).over(here)
        if split:
            value = F.when(F.row_number().over(here) == 1, F.col(f"__c_{out}")).otherwise(value)
        out_cols.append(value.alias(out))
    out_cols += [carried(F.sum(c).over(upto), out, plus).alias(out) for out, c in run_sum.items()]
    out_cols += [carried(F.max(c).over(upto), out, F.greatest).alias(out) for out, c in run_max.items()]
    out_cols += [carried(F.max(c).over(before), out, F.greatest).alias(out) for out, c in max_before.items()]
    return ranged.select(*df.columns, *out_cols)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per group, one output column per entry of ``probs``.

    Works on (value, count) pairs, so a value that fills a third of the table is one row, and no
    group is ever held in one task.
    """
    split = has_hot_group(df, keys)  # asked of the rows: an upper bound for the counts below, without computing them
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")))
    cum = ordered_scan(counts, keys, [value], run_sum={"__cum": "__c"}, split=split)
    if keys:
        cum = cum.join(counts.groupBy(*keys).agg(F.sum("__c").alias("__total")), keys)
    else:
        cum = cum.withColumn("__total", counts.agg(F.sum("__c")).scalar())
    picks = []
    for name, p in probs.items():
        target = F.lit(float(p)) * (F.col("__total") - 1)
        low = F.floor(target)
        lo = F.min(F.when(F.col("__cum") >= low + 1, F.col(value)))
        hi = F.min(F.when(F.col("__cum") >= low + 2, F.col(value)))
        picks += [lo.alias(f"__lo_{name}"), hi.alias(f"__hi_{name}"), F.max(target - low).alias(f"__f_{name}")]
    picked = cum.groupBy(*keys).agg(*picks)
    return picked.select(*keys, *[
        (F.col(f"__lo_{n}") + F.coalesce((F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}"), F.lit(0.0)))
        .alias(n) for n in probs])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, split: bool | None = None,
             hot_rows: int | None = None, rows: int | None = None) -> DataFrame:
    return ordered_scan(df, keys, order, number=name, split=split, hot_rows=hot_rows, rows=rows)


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows per group. Spark turns the rank filter into a per-task group limit before the shuffle."""
    sort, _ = _parse(df, order)
    rn = name or "__rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))).filter(F.col(rn) <= n)
    return out if name else out.drop(rn)
