"""Estimation logs as tables: iteration rows and parameter/gradient rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.groups import ordered_scan

# Marks and patterns of the log format.
ITERATION_MARK = "[Major Iteration #"
ITERATION_FIELDS = {
    "iteration": (r"^(\d+) 완료\]", "bigint"),
    "ll": (r"최종 LL: ([-+]?[\d.]+(?:[eE][-+]?\d+)?)", "double"),
    "line_search_calls": (r"Line Search: (\d+)회 함수 호출", "bigint"),
    "status": (r"Line Search: \d+회 함수 호출 - \[(.*?)\]", "string"),
    "func_calls": (r"함수 호출: (\d+)회 \(누적\)", "bigint"),
    "grad_calls": (r"그래디언트 호출: (\d+)회 \(누적\)", "bigint"),
    "ftol": (r"ftol = ([\d.eE+-]+)", "double"),
    "gtol": (r"gtol = ([\d.eE+-]+)", "double"),
}
ATTEMPT_MARK = "[Line Search 함수 호출 #"
ATTEMPT_FIELDS = {
    "major": (r"^iter(\d+)-", "bigint"),
    "attempt": (r"^iter\d+-(\d+)\]", "bigint"),
    "ll": (r"LL = ([-+]?[\d.]+(?:[eE][-+]?\d+)?)", "double"),
    "param_change": (r"파라미터 변화량 \(L2 norm\): ([\d.eE+-]+)", "double"),
    "ll_change": (r"함수값 변화: ([-+]?[\d.]+(?:[eE][-+]?\d+)?)", "double"),
}
TRACE_MARK = "전체 파라미터 값 및 그래디언트:"
TRACE_LINE = (r"\[\s*(\d+)\]\s+(\S+)\s+:\s+param=([+-]?\d+\.\d+e[+-]?\d+),\s+grad=([+-]?\d+\.\d+e[+-]?\d+)")
TIME = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"


def read_blocks(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """Log files cut at ``mark`` by the text reader itself, one block per row, so that a long log is
    split over tasks and never held as one value. The text before the first mark comes as a row too."""
    return (spark.read.option("lineSep", mark).text(path)
            .select(F.col("_metadata.file_name").alias("run"), F.col("value").alias("block")))


def blocks_of(df: DataFrame, text: str, mark: str, ids: list[str]) -> DataFrame:
    """The same for a text column that holds any number of blocks."""
    parts = F.split(F.col(text), F.regexp_replace(F.lit(mark), r"([\[\]().#])", r"\\$1"))
    return df.select(*ids, F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("block"))


def _fields(blocks: DataFrame, ids: list[str], fields: dict, required: str) -> DataFrame:
    out = []
    for name, (pattern, kind) in fields.items():
        found = F.regexp_extract("block", pattern, 1)
        found = F.when(found != "", found)
        out.append((found.try_cast(kind) if kind != "string" else found).alias(name))
    return blocks.select(*ids, *out).filter(F.col(required).isNotNull())


def iteration_rows(blocks: DataFrame, ids: list[str]) -> DataFrame:
    """One row per finished iteration: LL, line-search calls and status, call counters, ftol, gtol."""
    return _fields(blocks, ids, ITERATION_FIELDS, "iteration")


def iteration_stamps(blocks: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, iteration, ts). A stamp stands before the mark it belongs to, so the last stamp of a block is the
    time of the next iteration; the text before the first mark counts as iteration 0."""
    number, stamp = F.regexp_extract("block", ITERATION_FIELDS["iteration"][0], 1), F.regexp_extract("block", f"(?s).*{TIME}", 1)
    rows = blocks.select(*ids, F.when(number == "", 0).otherwise(number.try_cast("bigint")).cast("bigint").alias("iteration"),
                         F.when(stamp != "", stamp).alias("__stamp"))
    timed = ordered_scan(rows, ids, ["iteration"], lag={"ts": "__stamp"}).filter("iteration > 0")
    return timed.select(*ids, "iteration", F.to_timestamp("ts").alias("ts"))


def attempt_rows(blocks: DataFrame, ids: list[str]) -> DataFrame:
    """Line-search attempts: LL, parameter change, LL change."""
    return _fields(blocks, ids, ATTEMPT_FIELDS, "attempt")


def param_trace_rows(blocks: DataFrame, ids: list[str]) -> DataFrame:
    """One row per parameter line of a block: (index, parameter, value, gradient)."""
    get = lambda g: F.regexp_extract_all("block", F.lit(TRACE_LINE), F.lit(g))
    zipped = F.arrays_zip(get(1).alias("i"), get(2).alias("p"), get(3).alias("v"), get(4).alias("g"))
    return (blocks.select(*ids, F.explode(zipped).alias("z"))
            .select(*ids, F.col("z.i").cast("bigint").alias("param_index"), F.col("z.p").alias("parameter"),
                    F.col("z.v").cast("double").alias("value"), F.col("z.g").cast("double").alias("gradient")))


def read_estimation_log(spark: SparkSession, path: str) -> DataFrame:
    return iteration_rows(read_blocks(spark, path, ITERATION_MARK), ["run"])


def read_param_trace(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Parameter rows of every block; ``pos`` tells blocks apart and rises within a file, it is no iteration number.

    ``numbered``: the files are cut at the iteration marks, and each row has the ``iteration`` whose trace it is from."""
    if not numbered:
        blocks = read_blocks(spark, path, TRACE_MARK).withColumn("pos", F.monotonically_increasing_id())
        return param_trace_rows(blocks, ["run", "pos"])
    pattern, kind = ITERATION_FIELDS["iteration"]
    blocks = read_blocks(spark, path, ITERATION_MARK).select(
        "run", F.monotonically_increasing_id().alias("pos"), F.regexp_extract("block", pattern, 1).try_cast(kind).alias("iteration"),
        F.get(F.split("block", TRACE_MARK, 2), F.lit(1)).alias("block"))
    return param_trace_rows(blocks, ["run", "pos", "iteration"])
