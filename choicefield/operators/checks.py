"""Validation and cleaning: every check is a DataFrame of findings, every cleaner a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import groups
from ..functions.groups import first_n, numbered, ordered_scan
from ..functions.scalars import count_if
from ..session import stored


def require_columns(df: DataFrame, needed: list[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def domain_check(df: DataFrame, rules: dict[str, Column], min_rows: int = 100) -> DataFrame:
    """(rule, n_bad) for violation predicates, all in one pass; ``min_rows`` is 1 when the table is too short."""
    totals = df.agg(*[count_if(c).alias(r) for r, c in rules.items()],
                    F.when(F.count(F.lit(1)) < min_rows, 1).otherwise(0).cast("bigint").alias("min_rows"))
    return totals.unpivot([], [*rules, "min_rows"], "rule", "n_bad")


def is_missing(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    null = F.col(c).isNull()
    return null | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else null


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_missing, share): NULL and NaN both count."""
    columns = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[count_if(is_missing(df, c)).alias(c) for c in columns])
    return (one.unpivot(["__n"], columns, "column_name", "n_missing")
            .select("column_name", "n_missing", (F.col("n_missing") / F.col("__n")).alias("share")))


def stage_diff(before: DataFrame, after: DataFrame, key: str, items: list[str]) -> DataFrame:
    """(id, item, before, after, change) for every value that appeared, vanished or changed between stages.

    The stages meet once per id, in wide form; only the differences become rows.
    """
    b = before.select(key, F.struct(*[F.col(i).cast("double").alias(i) for i in items]).alias("b"))
    a = after.select(key, F.struct(*[F.col(i).cast("double").alias(i) for i in items]).alias("a"))
    cells = F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"b.{i}").alias("before_value"), F.col(f"a.{i}").alias("after_value")) for i in items])
    differ = F.filter(cells, lambda c: ~c["before_value"].eqNullSafe(c["after_value"]))
    out = b.join(a, key, "full_outer").select(key, F.explode(differ).alias("d")).select(key, "d.*")
    kind = (F.when(F.col("before_value").isNull(), "filled").when(F.col("after_value").isNull(), "lost").otherwise("changed"))
    return out.withColumn("change", kind)


def drop_all_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(how="all", subset=columns)


def listwise_delete(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(how="any", subset=subset)


def mean_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    return (df.withColumn("__m", means)
            .withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m.{c}")) for c in columns}).drop("__m"))


def cast_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def cast_choice(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("int"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def variance_profile(df: DataFrame, columns: list[str], tol: float = 0.0) -> DataFrame:
    """(column, variance, constant): the input of ``drop_zero_variance``."""
    one = df.agg(*[F.coalesce(F.var_samp(c), F.lit(0.0)).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "variance").withColumn("constant", F.col("variance") <= tol)


def drop_zero_variance(df: DataFrame, columns: list[str], tol: float = 0.0) -> DataFrame:
    """Drop constant columns. The column set of a plan must be known, so this runs the one-row profile."""
    constant = [r.column_name for r in variance_profile(df, columns, tol).filter("constant").collect()]
    return df.drop(*constant)


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_n(df, keys, order, 1)


def keep_first_n_per_id(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    return first_n(df, [key], order, n)


def duplicate_report(df: DataFrame, keys: list[str], expected: int = 1) -> DataFrame:
    """Keys with more than the expected number of rows."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > expected)
            .withColumn("n_extra", F.col("n_rows") - expected))


def duplicate_agreement(df: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """For keys with several rows: do all copies agree, column by column (NULL equals NULL)?

    One aggregate: all copies agree when smallest and largest are equal and NULLs are none or all.
    """
    n = F.count(F.lit(1))
    same = [(F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == n))).alias(f"same_{c}")
            for c in compare]
    out = df.groupBy(*keys).agg(n.alias("n_copies"), *same).filter(F.col("n_copies") > 1)
    agree = F.lit(True)
    for c in compare:
        agree = agree & F.col(f"same_{c}")
    return out.withColumn("all_same", agree)


def suffix_duplicate_ids(df: DataFrame, key: str, order: list[str], name: str = "unique_id") -> DataFrame:
    """id for the first copy, id_1, id_2, ... for the others."""
    ranked = numbered(df, [key], order, "__copy")
    text = F.col(key).cast("string")
    return (ranked.withColumn(name, F.when(F.col("__copy") > 1, F.concat_ws("_", text, F.col("__copy") - 1))
                              .otherwise(text)).drop("__copy"))


def reassign_duplicate_ids(df: DataFrame, key: str, order: list[str], name: str = "new_id") -> DataFrame:
    """Later copies of an id get the smallest unused ids, then max + 1, ...; first copies keep theirs."""
    total = df.count()  # no scan below has more than twice as many rows
    ranked = numbered(df, [key], order, "__copy", rows=total)
    later = stored(ranked.filter("__copy > 1"), "later_copies")
    extra = numbered(later, [], [key, *order], "__rank", rows=total)
    wanted = later.agg(F.count("*")).scalar()
    # gaps before each used id, counted along the ids
    split = total > groups.HOT_ROWS
    used = ordered_scan(df.select(key).distinct(), [], [key], lag={"__prev": key}, split=split, rows=total)
    low = F.greatest(F.coalesce(F.col("__prev"), F.lit(0)), F.lit(0))
    gaps = used.withColumn("__low", low).withColumn("__gap", F.greatest(F.col(key) - F.col("__low") - 1, F.lit(0)))
    gaps = ordered_scan(gaps, [], [key], run_sum={"__upto": "__gap"}, split=split, rows=total)
    first = F.col("__upto") - F.col("__gap")
    # a copy's rank falls into the last gap that starts before it: one ordered scan over gap starts and ranks together
    none = F.lit(None).cast("bigint")
    starts = gaps.filter((F.col("__gap") > 0) & (first < wanted)).select(
        (first + 1).cast("bigint").alias("__rank"), F.lit(0).alias("__kind"), F.col("__low").cast("bigint").alias("__low"), first.cast("bigint").alias("__first"))
    asked = extra.select("__rank", F.lit(1).alias("__kind"), none.alias("__low"), none.alias("__first"))
    free = (ordered_scan(starts.unionByName(asked), [], ["__rank", "__kind"], run_max={"__l": "__low", "__f": "__first"}, split=split, rows=2 * total)
            .filter("__kind = 1").select("__rank", (F.col("__l") + F.col("__rank") - F.col("__f")).alias("free")))
    top, n_gaps = df.agg(F.max(key)).scalar(), gaps.agg(F.sum("__gap")).scalar()
    moved = extra.join(free, "__rank").withColumn(
        name, F.when(F.col("__rank") <= n_gaps, F.col("free")).otherwise(top + F.col("__rank") - n_gaps)).select(*df.columns, "__copy", name)
    kept = ranked.filter("__copy = 1").withColumn(name, F.col(key))
    return kept.unionByName(moved).drop("__copy")


def drop_opt_out_sets(df: DataFrame, set_keys: list[str], chosen: str, opt_out: Column) -> DataFrame:
    """Drop the choice sets in which the opt-out was chosen, then the remaining opt-out rows."""
    lost = df.filter((F.col(chosen) == 1) & opt_out).select(*set_keys)
    return df.join(lost, set_keys, "left_anti").filter(~opt_out)


def coalesce_suffixes(df: DataFrame, suffixes: tuple[str, ...] = ("_dce", "_sem")) -> DataFrame:
    """x_dce, x_sem -> x (first non-null); columns with one side only are renamed."""
    first = [c[: -len(suffixes[0])] for c in df.columns if c.endswith(suffixes[0])]
    out = df
    for base in first:
        parts = [base + s for s in suffixes if base + s in df.columns]
        out = out.withColumn(base, F.coalesce(*parts)).drop(*parts)
    return out


def validate_long_choice(long: DataFrame, key: str, sid: str, alt: str, chosen: str) -> DataFrame:
    """(rule, n_bad): sets without exactly one choice, ids with choices != sets, repeated (set, alternative)."""
    per_set = long.groupBy(key, sid).agg(F.sum(chosen).alias("c"), F.count(F.lit(1)).alias("n"),
                                         F.countDistinct(alt).alias("k"))
    per_id = per_set.groupBy(key).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("sets"))
    a = per_set.agg(count_if(F.col("c") != 1).alias("one_choice_per_set"),
                    count_if(F.col("n") != F.col("k")).alias("alternative_repeated"))
    b = per_id.agg(count_if(F.col("c") != F.col("sets")).alias("choices_per_id"))
    return (a.unpivot([], ["one_choice_per_set", "alternative_repeated"], "rule", "n_bad")
            .unionByName(b.unpivot([], ["choices_per_id"], "rule", "n_bad")))


def answer_distribution_diff(wide: DataFrame, answers: dict[str, int], long: DataFrame, sid: str, alt: str,
                             chosen: str) -> DataFrame:
    """Answer counts of the questionnaire against chosen counts of the long table, per (set, alternative)."""
    set_of = F.create_map(*[F.lit(x) for q, s in answers.items() for x in (q, s)])
    asked = (wide.select(*[F.col(q).cast("bigint").alias(q) for q in answers]).unpivot([], list(answers), "q", "a")
             .filter("a is not null").groupBy(set_of[F.col("q")].cast("bigint").alias("sid"), F.col("a").alias("alt"))
             .agg(F.count(F.lit(1)).alias("n_source")))
    got = (long.filter(F.col(chosen) == 1)
           .groupBy(F.col(sid).cast("bigint").alias("sid"), F.col(alt).cast("bigint").alias("alt"))
           .agg(F.count(F.lit(1)).alias("n_long")))
    n, m = [F.coalesce(F.col(c), F.lit(0)) for c in ("n_source", "n_long")]
    return (asked.join(got, ["sid", "alt"], "full_outer")
            .select("sid", "alt", n.alias("n_source"), m.alias("n_long"), (n == m).alias("matches")))


def assert_row_preserving(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(n_left, n_joined, right_duplicates, ids_without_match, preserved) of a left join, without doing the join:
    per id only the two row counts meet."""
    lc = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    rc = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    j = lc.join(rc, key, "left").agg(
        F.sum("l").alias("n_left"), F.sum(F.col("l") * F.coalesce(F.col("r"), F.lit(1))).alias("n_joined"),
        count_if(F.col("r") > 1).alias("right_duplicates"), count_if(F.col("r").isNull()).alias("ids_without_match"))
    return j.withColumn("preserved", F.col("n_left") == F.col("n_joined"))

