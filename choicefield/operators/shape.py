"""Reshaping and joining: wide to long choices, integration by id, comparisons and small grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_if, safe_div


def wide_to_long_choice(wide: DataFrame, key: str, answers: dict[str, int], design: DataFrame) -> DataFrame:
    """Answers (one column per set) x design (sid, alt, attributes) -> one row per id, set and alternative.

    ``answers``: answer column -> set number. A respondent without an answer keeps the rows with chosen = 0.
    """
    sets = F.create_map(*[F.lit(x) for q, s in answers.items() for x in (q, s)])
    asked = (wide.select(key, *[F.col(q).cast("bigint").alias(q) for q in answers])
             .unpivot([key], list(answers), "question", "answer")
             .select(key, sets[F.col("question")].cast("bigint").alias("sid"), "answer"))
    hit = F.coalesce((F.col("alt") == F.col("answer")).cast("int"), F.lit(0))
    return asked.join(design, "sid").select(key, *design.columns, hit.alias("chosen"))


def merge_factors_inner(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner join on id; a column name that occurs in several tables gets its table's name as suffix."""
    names = [c for df in tables.values() for c in df.columns if c != key]
    clash = {c for c in names if names.count(c) > 1}
    renamed = [df.withColumnsRenamed({c: f"{c}_{name}" for c in df.columns if c in clash})
               for name, df in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "inner"), renamed)


def common_ids(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [df.select(key) for df in tables])


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def except_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right, key, "left_anti")


def integrate_left(long: DataFrame, individual: list[DataFrame], key: str) -> DataFrame:
    """Long choice table with individual-level tables (one row per id each) joined on.

    The individual tables are joined to each other first: they are small next to the choice rows, so
    the long side is shuffled once, not once per table.
    """
    ids = reduce(lambda a, b: a.join(b, key, "full_outer"), individual)
    return long.join(ids, key, "left")


def attach_scores(long: DataFrame, scores: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return long.join(scores.select(key, *columns), key, "left")


def integrate_how(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
                  suffixes: tuple[str, str] = ("_dce", "_sem")) -> DataFrame:
    clash = set(left.columns) & set(right.columns) - {key}
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return a.join(b, key, how)


def integrate_summary(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Sizes before and after, ids after, and the ratio, from the two per-id counts (the join itself is not run)."""
    l = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))  # noqa: E741
    r = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    j = l.join(r, key, "full_outer")
    keep = {"inner": F.col("l").isNotNull() & F.col("r").isNotNull(), "left": F.col("l").isNotNull(),
            "right": F.col("r").isNotNull(), "outer": F.lit(True)}[how]
    rows = F.coalesce(F.col("l"), F.lit(1)) * F.coalesce(F.col("r"), F.lit(1))
    out = j.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_size"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_size"),
                F.coalesce(F.sum(F.when(keep, rows)), F.lit(0)).alias("merged_size"), count_if(keep).alias("merged_ids"))
    return out.withColumn("merge_ratio", safe_div(F.col("merged_size"), F.greatest("left_size", "right_size")))


def id_compatibility(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of ids on both sides, left only and right only."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()  # noqa: E741
    return a.join(b, key, "full_outer").agg(count_if(l & r).alias("common_ids"), count_if(l & ~r).alias("left_only"),
                                            count_if(~l & r).alias("right_only"), count_if(l).alias("left_ids"),
                                            count_if(r).alias("right_ids"))


def crosstab(df: DataFrame, rows: str, columns: str, levels: list) -> DataFrame:
    """Level x level counts as columns; the levels are given, so no extra pass collects them."""
    return df.groupBy(rows).agg(*[count_if(F.col(columns) == v).alias(str(v)) for v in levels])


# ---- comparisons -----------------------------------------------------------------------------------------

def compare_loadings(before: DataFrame, after: DataFrame, item: str = "item", loading: str = "loading") -> DataFrame:
    b = before.select(item, "factor", F.col(loading).alias("before"))
    j = b.join(after.select(item, F.col(loading).alias("after")), item)
    x, y = F.col("before"), F.col("after")
    return j.select(item, "factor", "before", "after", (y - x).alias("change"), F.abs(y - x).alias("abs_change"),
                    (x * y < 0).alias("sign_changed"), (F.abs(x) >= 0.5).alias("before_acceptable"),
                    (F.abs(y) >= 0.5).alias("after_acceptable"), (F.abs(y) > F.abs(x)).alias("improved"))


# Direction of fit metrics.
HIGHER_IS_BETTER = "CFI|TLI|GFI|AGFI"
LOWER_IS_BETTER = "RMSEA|SRMR|CHI-SQUARE|AIC|BIC"


def compare_fit(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Change per fit metric (``keys`` end with the metric column); improvement follows the metric's direction."""
    j = (before.select(*keys, F.col(value).alias("before"))
         .join(after.select(*keys, F.col(value).alias("after")), keys))
    x, y, name = F.col("before"), F.col("after"), F.upper(keys[-1])
    better = (F.when(name.rlike(HIGHER_IS_BETTER), y > x).when(name.rlike(LOWER_IS_BETTER), y < x)
              .otherwise(F.abs(y) < F.abs(x)))
    return j.select(*keys, "before", "after", (y - x).alias("change"),
                    F.when(x != 0, (y - x) / F.abs(F.when(x != 0, x)) * 100).otherwise(0.0).alias("percent_change"),
                    better.alias("improved"))


def compare_estimates(left: DataFrame, right: DataFrame, keys: list[str], value: str,
                      names: tuple[str, str] = ("left_value", "right_value")) -> DataFrame:
    """Two sets of estimates side by side; a parameter of one side only stays, with NULL difference."""
    a, b = names
    j = left.select(*keys, F.col(value).alias(a)).join(right.select(*keys, F.col(value).alias(b)), keys, "full_outer")
    d = F.col(b) - F.col(a)
    return j.select(*keys, a, b, d.alias("difference"), (100 * safe_div(d, F.abs(a))).alias("percent"),
                    (F.signum(a) * F.signum(b) < 0).alias("sign_differs"))


def pair_models(models: DataFrame, structure: str, first, second, model_keys: list[str], value: str) -> DataFrame:
    """The same choice model under two path structures: value of each and their difference."""
    a = models.filter(F.col(structure) == first).select(*model_keys, F.col(value).alias("first"))
    b = models.filter(F.col(structure) == second).select(*model_keys, F.col(value).alias("second"))
    return a.join(b, model_keys).withColumn("difference", F.col("first") - F.col("second"))


# ---- paths and grids -------------------------------------------------------------------------------------

def path_exists(pairs: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """For asked (from_var, to_var) pairs: the estimate of the direct edge, else 0."""
    p = paths.select(*keys, F.col("rval").alias("from_var"), F.col("lval").alias("to_var"), "estimate")
    j = pairs.join(p, [*keys, "from_var", "to_var"], "left")
    return j.select(*keys, "from_var", "to_var", F.col("estimate").isNotNull().alias("found"),
                    F.coalesce("estimate", F.lit(0.0)).alias("estimate"))


def ordered_pairs(nodes: DataFrame, keys: list[str], node: str) -> DataFrame:
    """All (from_var, to_var), from != to, within ``keys``; nodes are a handful of factors per model."""
    a = nodes.select(*keys, F.col(node).alias("from_var"))
    b = nodes.select(*keys, F.col(node).alias("to_var"))
    return a.join(b, keys).filter("from_var <> to_var")


def missing_paths(nodes: DataFrame, paths: DataFrame, keys: list[str], node: str) -> DataFrame:
    p = paths.select(*keys, F.col("rval").alias("from_var"), F.col("lval").alias("to_var"))
    return ordered_pairs(nodes, keys, node).join(p, [*keys, "from_var", "to_var"], "left_anti")


def stack_paths(tables: dict[str, DataFrame], tag: str = "target") -> DataFrame:
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pair_enumeration(nodes: DataFrame, keys: list[str], node: str) -> DataFrame:
    """All (x, m, y) of different factors within ``keys``: 5 factors give 60."""
    p = ordered_pairs(nodes, keys, node).toDF(*keys, "x", "m")
    y = nodes.select(*keys, F.col(node).alias("y"))
    return p.join(y, keys).filter("y <> x and y <> m")


def model_grid(base: DataFrame, lvs: list[str], attrs: list[str]) -> DataFrame:
    """Every row of ``base`` with every hierarchically valid model: main effects (subset of the LVs) and
    LV:attribute interactions whose LV is a main effect. Subsets are bit masks (62 interactions at most); only valid ones
    are made, by doubling the rows once for each interaction that a model may have."""
    pairs = [(i, f"{lv}:{a}") for i, lv in enumerate(lvs) for a in attrs]
    mains = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(lvs) - 1))).alias("main_mask")

    def bit(mask: Column, i: int) -> Column:
        return F.shiftright(mask, i).bitwiseAND(1) == 1
    grid = base.select("*", mains).withColumn("inter_mask", F.lit(0).cast("bigint"))
    for j, (i, _) in enumerate(pairs):
        choices = F.when(bit(F.col("main_mask"), i), F.array(F.lit(0).cast("bigint"), F.lit(1 << j).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
        grid = grid.withColumn("__add", F.explode(choices)).withColumn("inter_mask", F.col("inter_mask") + F.col("__add")).drop("__add")
    grid = grid.withColumn("inter_mask", F.col("inter_mask").cast("int" if len(pairs) < 31 else "bigint"))
    main = F.concat_ws(",", *[F.when(bit(F.col("main_mask"), i), lv) for i, lv in enumerate(lvs)])
    inter = F.concat_ws(",", *[F.when(bit(F.col("inter_mask"), j), name) for j, (_, name) in enumerate(pairs)])
    return grid.withColumns({"main_lvs": main, "interactions": inter})


def scenario_grid(base: DataFrame, columns: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Every base row at every point of a grid (column -> low, high, steps)."""
    out = base
    for name, (low, high, steps) in columns.items():
        width = (high - low) / (steps - 1)
        out = (out.drop(name).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
               .withColumn(name, F.lit(float(low)) + F.col("__i") * F.lit(width)).drop("__i"))
    return out


def modification_filter(df: DataFrame, value: str, threshold: float, k: int, order: list[str]) -> DataFrame:
    """Largest k rows at or above a threshold."""
    return top_k(df.filter(F.col(value) >= threshold), [f"-{value}", *order], k)


def top_k(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """First k rows along ``order`` ("-c" = descending); the last entries break ties."""
    return df.orderBy(*[F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]).limit(k)
