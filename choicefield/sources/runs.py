"""Result runs: scanning result files, run names, parameter names, and the results catalog."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.groups import first_n
from ..functions.scalars import count_if

# Abbreviations used in run names.
LV_NAMES = {"HC": "health_concern", "PB": "perceived_benefit", "PP": "perceived_price",
            "NK": "nutrition_knowledge", "PI": "purchase_intention"}
ATTR_NAMES = {"hl": "health_label", "pr": "price"}
STAGE1_PATHS = ["HC->PB", "HC->PP", "HC->PI", "PB->PI", "PP->PI", "NK->PI"]
HEADERS = 1000
RUN_NAME = r"^st2_(.+?)1_(.+)2"


def read_result_runs(spark: SparkSession, paths: str | list[str], fmt: str = "csv") -> DataFrame:
    """Rows of every result file with ``run_file`` (file name) and ``run`` (name without endings).

    CSV files may have different headers: each is read under its own, and a column that a file lacks is NULL there. Values are
    strings and hold no line breaks. Files meet their headers inside Spark; what reaches the driver are the different headers, at
    most ``HEADERS``. A row that repeats the header is left out.
    """
    paths = [paths] if isinstance(paths, str) else paths
    name = F.col("_metadata.file_name")
    ids = [name.alias("run_file"), F.regexp_replace(name, r"(_results)?\.[a-z]+$", "").alias("run")]
    if fmt != "csv":
        return spark.read.format(fmt).load(paths).select("*", *ids)
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start", *ids)
    # the first line of a file: the smallest position in its first block
    first = lines.filter("file_block_start = 0").withColumn("pos", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("value", "pos").alias("head"))
    heads = [r["head"] for r in first.select("head").distinct().orderBy("head").limit(HEADERS + 1).collect()]
    if len(heads) > HEADERS:
        raise ValueError(f"more than {HEADERS} different headers")
    rows = lines.join(first, "file_path").filter("value <> head and value <> ''")
    tables = []
    for head in heads:
        names = next(csv.reader([head.removeprefix("\ufeff")]))
        if len(set(names)) < len(names):
            raise ValueError(f"a column stands twice in the header {head!r}")
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        own = rows.filter(F.col("head") == head).select(F.from_csv("value", schema).alias("r"), "run_file", "run")
        tables.append(own.select("r.*", "run_file", "run"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else lines.select("run_file", "run")


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def parse_run_name(df: DataFrame, name: str) -> DataFrame:
    """Adds ``paths``, ``main_lvs`` and ``interactions`` (sorted string arrays) read from a run name.

    A name looks like ``st2_HC-PB_PB-PI1_NK_PI_int_PIxhl2_results.csv``; unknown parts are ignored and a
    name of another form gives NULLs.
    """
    lv, attr = _literal_map(LV_NAMES), _literal_map(ATTR_NAMES)
    stage1, stage2 = F.regexp_extract(name, RUN_NAME, 1), F.regexp_extract(name, RUN_NAME, 2)
    pieces = F.split(stage2, "_int_")
    known = F.array(*[F.lit(p) for p in STAGE1_PATHS])
    paths = F.filter(F.transform(F.split(stage1, "_"), lambda p: F.replace(p, F.lit("-"), F.lit("->"))),
                     lambda p: F.array_contains(known, p))
    main = F.filter(F.transform(F.split(F.get(pieces, 0), "_"), lambda a: F.element_at(lv, a)), lambda a: a.isNotNull())

    def pair(item: Column) -> Column:
        cut = F.instr(item, "x")
        left = F.element_at(lv, F.substr(item, F.lit(1), cut - 1))
        right = F.element_at(attr, F.substr(item, cut + 1))
        return F.when(cut > 0, F.concat(left, F.lit(":"), right))
    inter = F.filter(F.transform(F.split(F.coalesce(F.get(pieces, 1), F.lit("")), "_"), pair),
                     lambda p: p.isNotNull())
    ok = stage1 != ""
    return df.select("*", F.when(ok, F.array_sort(F.array_distinct(paths))).alias("paths"),
                     F.when(ok, F.array_sort(F.array_distinct(main))).alias("main_lvs"),
                     F.when(ok, F.array_sort(F.array_distinct(inter))).alias("interactions"))


def run_name(paths: Column, main: Column, inter: Column) -> Column:
    """The inverse of ``parse_run_name``: arrays of abbreviations -> run name."""
    tail = F.when(F.size(inter) > 0, F.concat(F.lit("_int_"), F.array_join(inter, "_"))).otherwise("")
    head = F.when(F.size(main) > 0, F.array_join(main, "_")).otherwise("base")
    return F.concat(F.lit("st2_"), F.array_join(paths, "_"), F.lit("1_"), head, tail, F.lit("2_results.csv"))


def parameter_parts(df: DataFrame, parameter: str) -> DataFrame:
    """Adds ``lv`` and ``attr`` named by a parameter: ``theta_<alt>_<lv>`` or ``gamma_<alt>_<lv>_<attr>``."""
    body = F.regexp_replace(parameter, "^(theta|gamma)_(sugar_free_|sugar_)?", "")
    ending = "_(" + "|".join(ATTR_NAMES.values()) + ")$"
    is_gamma = F.startswith(F.col(parameter), F.lit("gamma_"))
    attr = F.when(is_gamma & F.regexp_like(body, F.lit(ending)), F.regexp_extract(body, ending, 1))
    lv = (F.when(F.startswith(F.col(parameter), F.lit("theta_")), body)
          .when(attr.isNotNull(), F.regexp_replace(body, ending, "")))
    return df.select("*", lv.alias("lv"), attr.alias("attr"))


def parse_run_params(df: DataFrame, run: str, parameter: str) -> DataFrame:
    """Per run the main LVs and LV:attribute interactions that its parameter names contain."""
    p = parameter_parts(df, parameter)
    main = F.collect_set(F.when(F.col("attr").isNull(), F.col("lv")))
    inter = F.collect_set(F.when(F.col("attr").isNotNull(), F.concat_ws(":", "lv", "attr")))
    return p.groupBy(run).agg(F.array_sort(main).alias("main_lvs"), F.array_sort(inter).alias("interactions"))


def check_run_consistency(names: DataFrame, contents: DataFrame, run: str) -> DataFrame:
    """Where the sets read from a run's name and from its parameters differ, in either direction."""
    c = contents.select(run, F.col("main_lvs").alias("c_main"), F.col("interactions").alias("c_inter"))
    j = names.select(run, "main_lvs", "interactions").join(c, run, "full_outer")
    empty = F.array().cast("array<string>")
    main, inter, c_main, c_inter = [F.coalesce(F.col(x), empty) for x in
                                    ("main_lvs", "interactions", "c_main", "c_inter")]
    diffs = {"only_name_main": F.array_except(main, c_main), "only_file_main": F.array_except(c_main, main),
             "only_name_inter": F.array_except(inter, c_inter), "only_file_inter": F.array_except(c_inter, inter)}
    out = j.select(run, *[F.array_join(F.array_sort(v), ",").alias(k) for k, v in diffs.items()])
    return out.withColumn("consistent", F.concat(*diffs) == "")


def write_results(df: DataFrame, path: str, analysis: str, run_ts: str, fmt: str = "parquet") -> None:
    """Append a result table under ``analysis=.../run_ts=...``."""
    (df.withColumn("analysis", F.lit(analysis)).withColumn("run_ts", F.lit(run_ts))
     .write.partitionBy("analysis", "run_ts").mode("append").format(fmt)
     .option("header", True).save(path))


def read_results(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                 analysis: str | None = None) -> DataFrame:
    """Read the store back; a filter on ``analysis`` prunes folders."""
    df = (spark.read.format(fmt).option("header", True)
          .schema(f"{schema}, analysis string, run_ts string").load(path))
    return df if analysis is None else df.filter(F.col("analysis") == analysis)


def save_factor_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_factor_scores(spark: SparkSession, path: str, key: str, factors: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(key, *factors)


def latest_run(df: DataFrame, analysis: str, ts: str, run: str) -> DataFrame:
    """Newest version per analysis; equal stamps go to the smallest run name."""
    w = Window.partitionBy(analysis).orderBy(F.col(ts).desc(), F.col(run).asc())
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def runs_to_expire(df: DataFrame, analysis: str, ts: str, run: str, keep: int) -> DataFrame:
    """Versions older than the newest ``keep``: everything but the group-limited newest rows."""
    newest = first_n(df.withColumn("__ts", F.unix_micros(F.col(ts).cast("timestamp"))), [analysis], ["-__ts", run], keep)
    return df.join(newest.select(analysis, run), [analysis, run], "left_anti")


def run_summary(df: DataFrame, analysis: str, ts: str) -> DataFrame:
    return df.groupBy(analysis).agg(F.count(F.lit(1)).alias("n_versions"), F.max(ts).alias("latest"),
                                    F.min(ts).alias("oldest"))


def significant_params(df: DataFrame, run: str, parameter: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Runs with at least one significant parameter, with counts by kind (theta / gamma)."""
    sig = df.filter(F.col(p) < alpha)
    return sig.groupBy(run).agg(F.count(F.lit(1)).alias("n_significant"),
                                count_if(F.col(parameter).contains("theta")).alias("n_theta"),
                                count_if(F.col(parameter).contains("gamma")).alias("n_gamma"),
                                F.min(p).alias("min_p"))
