"""Readers for questionnaire tables, designs and item metadata."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.groups import first_n
from ..functions.scalars import no_nan

BOM = "﻿"


def _open(spark: SparkSession, path: str | list[str], fmt: str) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    if fmt != "csv":
        return spark.read.format(fmt).load(paths)
    raw = spark.read.option("header", True).csv(paths)
    return raw.withColumnsRenamed({c: c.replace(BOM, "").strip() for c in raw.columns if c != c.replace(BOM, "").strip()})


def read_responses(spark: SparkSession, path: str | list[str], columns: dict[str, str],
                   fmt: str = "csv") -> DataFrame:
    """Fixed column subset (name -> type) of a wide table; a byte-order mark in the header is dropped.

    Text that does not parse becomes NULL and NaN becomes NULL, so later steps see one missing value.
    """
    df = _open(spark, path, fmt)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    have = dict(df.dtypes)
    out = []
    for c, t in columns.items():
        v = F.col(c) if have[c] == t else F.col(c).try_cast(t)
        out.append((no_nan(v) if t in ("double", "float") else v).alias(c))
    return df.select(*out)


def read_factor_tables(spark: SparkSession, specs: dict[str, tuple[str, str, list[str]]],
                       fmt: str = "csv") -> DataFrame:
    """Factor tables in long form (id, factor, item, value); ``specs``: factor -> (path, id column, items).

    A file that does not exist is skipped with a warning.
    """
    out = None
    for factor, (path, key, items) in specs.items():
        try:
            df = read_responses(spark, path, {key: "bigint", **{i: "double" for i in items}}, fmt)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            warnings.warn(f"factor {factor}: no file {path}", stacklevel=2)
            continue
        long = (df.withColumnRenamed(key, "id").unpivot(["id"], items, "item", "value")
                .select("id", F.lit(factor).alias("factor"), "item", "value"))
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise FileNotFoundError("none of the factor tables exists")
    return out


def split_factor_tables(df: DataFrame, key: str, order: list[str], factors: dict[str, list[str]]) -> DataFrame:
    """Wide table -> long (id, factor, item, value), first row per id; write it ``partitionBy("factor")``."""
    items = [i for cols in factors.values() for i in cols]
    needed = [o.lstrip("-") for o in order]
    first = first_n(df.select(key, *dict.fromkeys([*needed, *items])), [key], order, 1)
    wide = first.select(F.col(key).alias("id"), *[F.col(i).cast("double").alias(i) for i in items])
    factor_of = F.create_map(*[F.lit(x) for f, cols in factors.items() for i in cols for x in (i, f)])
    return wide.unpivot(["id"], items, "item", "value").select("id", factor_of[F.col("item")].alias("factor"), "item", "value")


def read_design(spark: SparkSession, path: str, set_col: str, alt_col: str, attrs: dict[str, str],
                fmt: str = "csv") -> DataFrame:
    """Choice design: one row per (set, alternative) with typed, nullable attributes."""
    df = read_responses(spark, path, {set_col: "bigint", alt_col: "bigint", **attrs}, fmt)
    return df.withColumnsRenamed({set_col: "sid", alt_col: "alt"})


METADATA_SCHEMA = ("scale_range struct<min:int,max:int>, reverse_items "
                   "map<string,struct<items:array<string>,reverse_items:array<string>>>")


def read_item_metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSON item metadata -> one row (factor, item, position, is_reversed, scale_min, scale_max)."""
    meta = spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(path)
    return (meta.select("scale_range", F.explode("reverse_items").alias("factor", "m"))
            .select("scale_range", "factor", "m.reverse_items", F.posexplode("m.items").alias("position", "item"))
            .select("factor", "item", "position", F.array_contains("reverse_items", F.col("item")).alias("is_reversed"),
                    F.col("scale_range.min").alias("scale_min"), F.col("scale_range.max").alias("scale_max")))


def explode_json_map(df: DataFrame, ids: list[str], column: str, value_type: str = "int") -> DataFrame:
    """A JSON object per row -> one row per (ids, key, value)."""
    return df.select(*ids, F.explode(F.from_json(column, f"map<string,{value_type}>")).alias("key", "value"))
