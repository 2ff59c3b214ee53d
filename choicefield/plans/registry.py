"""Registry of checkable queries: a Spark callable and, where SQL can say it, its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tables:
    """Lazy access to the parquet tables of one folder: ``Tables(spark, dir).lineitem``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.facts: dict = {}

    def file(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.file(name))


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    digits: dict[str, int]
    default_digits: int

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.build(Tables(spark, path))
        return df.select(*[
            (F.round(F.col(f.name), self.digits.get(f.name, self.default_digits)) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])

    def oracle(self) -> str | None:
        """The SQL with its double columns rounded like the Spark result (float sums differ in the last bits)."""
        if self.sql is None or not self.digits:
            return self.sql
        rounded = ", ".join(f"round({c}, {d}) + CAST(0 AS DOUBLE) AS {c}" for c, d in self.digits.items())
        return f"SELECT * REPLACE ({rounded}) FROM ({self.sql}) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``build(tables)``. ``doubles`` lists the double columns, optionally as ``name:digits``."""
    spec = {}
    for item in doubles.split():
        c, _, d = item.partition(":")
        spec[c] = int(d) if d else digits

    def keep(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql, spec, digits)
        return build
    return keep
