"""Encodings and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import exact_quantiles
from ..functions.scalars import add, count_if

MIN_SD = 1e-10


# ---- questionnaire items ---------------------------------------------------------------------------------

def reverse_code(df: DataFrame, items: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """max + min - x on the reversed items; NULL stays NULL."""
    return df.withColumns({i: F.lit(high + low) - F.col(i) for i in items})


def reverse_code_verify(before: DataFrame, after: DataFrame, items: list[str], low: int = 1, high: int = 5,
                        tol: float = 0.001) -> DataFrame:
    """(item, original_mean, reversed_mean, expected_mean, diff, success)."""
    def means(df, name):
        return df.agg(*[F.avg(i).alias(i) for i in items]).unpivot([], items, "item", name)
    j = means(before, "original_mean").join(means(after, "reversed_mean"), "item")
    j = j.withColumn("expected_mean", F.lit(float(high + low)) - F.col("original_mean"))
    diff = F.abs(F.col("reversed_mean") - F.col("expected_mean"))
    return j.withColumn("diff", diff).withColumn("success", F.col("diff") < tol)


def reverse_code_summary(dim: DataFrame) -> DataFrame:
    """Per factor: number of items, of reversed items, and their names."""
    rev = F.col("is_reversed")
    return dim.groupBy("factor").agg(
        F.count(F.lit(1)).alias("n_items"), count_if(rev).alias("n_reversed"),
        F.array_join(F.array_sort(F.collect_set(F.when(rev, F.col("item")))), ",").alias("reversed_items"))


# ---- categories ------------------------------------------------------------------------------------------

def level_map(column: str, mapping: dict) -> Column:
    """Label -> value; labels that are not listed become NULL."""
    out = None
    for label, value in mapping.items():
        hit = F.col(column) == F.lit(label)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def ordinal_midpoint(column: str, midpoints: dict) -> Column:
    """Ordinal class -> midpoint; the mapping is the caller's (surveys code income differently)."""
    return level_map(column, {k: float(v) for k, v in midpoints.items()})


def level_map_verify(df: DataFrame, source: str, coded: str) -> DataFrame:
    return df.groupBy(source, coded).agg(F.count(F.lit(1)).alias("n"))


def effects_code(column: str) -> Column:
    """{0, 1} -> {-1, +1}; anything else, NULL included, stays NULL."""
    return F.when(F.col(column) == 1, 1.0).when(F.col(column) == 0, -1.0)


def alt_dummy(alt: str, value, name: str) -> Column:
    return F.when(F.col(alt) == value, 1).otherwise(0).alias(name)


# ---- scaling ---------------------------------------------------------------------------------------------

def scale_stats(df: DataFrame, columns: list[str], ddof: int) -> DataFrame:
    """One row of mu_<c>, sd_<c> over the non-null rows: the stored state of a standardiser."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    return df.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("mu", F.avg), ("sd", sd))])


def _z(c: str, s: str) -> Column:
    centred = F.col(c) - F.col(f"{s}.mu_{c}")
    sd = F.col(f"{s}.sd_{c}")
    return F.when(sd > MIN_SD, centred / sd).otherwise(centred)


def _attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The one-row stats as a scalar subquery: computed once, no join."""
    return df.withColumn("__s", stats.select(F.struct(*stats.columns)).scalar())


def zscore_apply(df: DataFrame, columns: list[str], stats: DataFrame, suffix: str = "_z") -> DataFrame:
    """Standardise with stored statistics; a constant column is only centred."""
    return _attach(df, stats).withColumns({c + suffix: _z(c, "__s") for c in columns}).drop("__s")


def zscore_inverse(df: DataFrame, columns: list[str], stats: DataFrame, suffix: str = "_z") -> DataFrame:
    """Back from c_z to c_back."""
    back = {}
    for c in columns:
        sd = F.col(f"__s.sd_{c}")
        back[f"{c}_back"] = F.col(c + suffix) * F.when(sd > MIN_SD, sd).otherwise(1.0) + F.col(f"__s.mu_{c}")
    return _attach(df, stats).withColumns(back).drop("__s")


def zscore_pop(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    return zscore_apply(df, columns, scale_stats(df, columns, 0), suffix)


def zscore_sample(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    return zscore_apply(df, columns, scale_stats(df, columns, 1), suffix)


def center(df: DataFrame, columns: list[str], suffix: str = "_c") -> DataFrame:
    stats = df.agg(*[F.avg(c).alias(f"mu_{c}") for c in columns])
    return _attach(df, stats).withColumns({c + suffix: F.col(c) - F.col(f"__s.mu_{c}") for c in columns}).drop("__s")


def scale_by(column: str, factor: float) -> Column:
    return F.col(column) / F.lit(float(factor))


# ---- interactions ----------------------------------------------------------------------------------------

def interact_product(x: str, z: str) -> Column:
    return F.col(x) * F.col(z)


def interact_residual(df: DataFrame, x: str, z: str, name: str = "xz_resid") -> DataFrame:
    """Residual-centred product: what is left of x*z after regressing it on 1, x and z."""
    full = df.filter(F.col(x).isNotNull() & F.col(z).isNotNull())
    p = F.col(x) * F.col(z)
    m = full.agg(F.avg(x).alias("mx"), F.avg(z).alias("mz"), F.avg(p).alias("mp"),
                 F.var_pop(x).alias("vx"), F.var_pop(z).alias("vz"), F.covar_pop(x, z).alias("cxz"),
                 F.covar_pop(F.col(x).cast("double"), p).alias("cxp"),
                 F.covar_pop(F.col(z).cast("double"), p).alias("czp"))
    det = F.col("vx") * F.col("vz") - F.col("cxz") * F.col("cxz")
    det = F.when(det != 0, det)
    m = m.withColumns({"bx": (F.col("vz") * F.col("cxp") - F.col("cxz") * F.col("czp")) / det,
                       "bz": (F.col("vx") * F.col("czp") - F.col("cxz") * F.col("cxp")) / det})
    s = F.col
    resid = p - s("__s.mp") - s("__s.bx") * (s(x) - s("__s.mx")) - s("__s.bz") * (s(z) - s("__s.mz"))
    return _attach(df, m).withColumn(name, resid).drop("__s")


# Named attribute interactions (a "_normalized" price falls back to price when absent).
INTERACTIONS = {
    "sugar_health": ("sugar_free", "health_label"),
    "sugar_price": ("sugar_free", "price"),
    "health_price": ("health_label", "price"),
    "three_way": ("sugar_free", "health_label", "price_normalized"),
    "sugar_health_normalized": ("sugar_free", "health_label"),
    "sugar_price_normalized": ("sugar_free", "price_normalized"),
    "health_price_normalized": ("health_label", "price_normalized"),
}


def interact_typed(df: DataFrame, roles: dict[str, str], kinds: list[str] | None = None) -> DataFrame:
    """One column per named interaction. ``roles``: sugar_free, health_label, price[, price_normalized] -> column."""
    where = {**roles, "price_normalized": roles.get("price_normalized", roles["price"])}

    def product(kind):
        out = None
        for r in INTERACTIONS[kind]:
            out = F.col(where[r]) if out is None else out * F.col(where[r])
        return out
    return df.withColumns({k: product(k) for k in kinds or INTERACTIONS})


def interact_factor_attr(df: DataFrame, factors: list[str], attrs: list[str]) -> DataFrame:
    """<factor>_direct and <factor>_x_<attr> for every factor and attribute."""
    cols = {f"{f}_direct": F.col(f) for f in factors}
    cols |= {f"{f}_x_{a}": F.col(f) * F.col(a) for f in factors for a in attrs}
    return df.withColumns(cols)


# ---- bins and grades -------------------------------------------------------------------------------------

def bin_fixed(column: str, edges=(0.0, 0.33, 0.67, 1.0), labels=("Low", "Medium", "High")) -> Column:
    """Right-closed intervals, lowest edge included, outside -> NULL."""
    x = F.col(column)
    out = F.when(x < edges[0], F.lit(None).cast("string"))
    for hi, label in zip(edges[1:], labels):
        out = out.when(x <= hi, label)
    return out


def bin_tertile(df: DataFrame, column: str, name: str = "tertile", probs=(0.33, 0.67),
                labels=("Low", "Medium", "High")) -> DataFrame:
    """Cut at exact quantiles; right-closed. Values beyond both cuts go to the last label."""
    cuts = exact_quantiles(df, [], column, {f"c{i}": p for i, p in enumerate(probs)})
    cond = F.when(F.col(column).isNull(), F.lit(None).cast("string"))
    for i, label in enumerate(labels[:-1]):
        cond = cond.when(F.col(column) <= F.col(f"__s.c{i}"), label)
    return _attach(df, cuts).withColumn(name, cond.otherwise(labels[-1])).drop("__s")


def grade_fit_index(name: Column, value: Column) -> Column:
    """CFI, TLI: .95 / .90; RMSEA, SRMR: .05 / .08."""
    up = F.when(value >= 0.95, "Excellent").when(value >= 0.90, "Good").otherwise("Poor")
    down = F.when(value <= 0.05, "Excellent").when(value <= 0.08, "Good").otherwise("Poor")
    return (F.when(value.isNull(), "N/A").when(name.isin("CFI", "TLI"), up)
            .when(name.isin("RMSEA", "SRMR"), down).otherwise("N/A"))


def grade_loading(value: Column) -> Column:
    a = F.abs(value)
    return F.when(a >= 0.7, "Strong").when(a >= 0.5, "Moderate").when(a >= 0.3, "Weak").otherwise("Very Weak")


# Parameter prefix -> model part.
PARAM_PARTS = {"gamma_": "structural", "asc_": "choice_fixed", "beta_": "choice_fixed", "theta_": "choice_lv",
               "zeta_": "measurement", "tau_": "measurement"}


def param_group(parameter: Column) -> Column:
    out = None
    for prefix, part in PARAM_PARTS.items():
        hit = F.startswith(parameter, F.lit(prefix))
        out = F.when(hit, part) if out is None else out.when(hit, part)
    return out.otherwise("other")


def factor_score_mean(items: list[str]) -> Column:
    """Row mean that skips NULLs; all NULL -> NULL."""
    n = add([F.when(F.col(i).isNotNull(), 1).otherwise(0) for i in items])
    total = add([F.coalesce(F.col(i).cast("double"), F.lit(0.0)) for i in items])
    return total / F.when(n > 0, n)


def factor_score_sum(items: list[str]) -> Column:
    """Row sum; NULL counts as 0."""
    return add([F.coalesce(F.col(i).cast("double"), F.lit(0.0)) for i in items])
