"""Sums of large vectors and k x k matrices: one block per partition, added across a tree of tasks.

A block is what one partition sums up from its Arrow batches, so the plan does not grow with k (k (k + 1) / 2 generated
aggregates do), and what travels is a block per partition, of 8 k^2 bytes. ``FAN`` tasks add the blocks of all partitions, and
only their results meet in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FAN = 16
SCHEMA = "block binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for block in batch.column("block").to_pylist():
            values = np.frombuffer(block)
            total = values.copy() if total is None else total + values
    if total is not None:
        yield pa.RecordBatch.from_pydict({"block": [total.tobytes()]})


def blocks(df: DataFrame, vectors: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]]) -> DataFrame:
    """At most ``FAN`` rows whose sum is that of all vectors which ``vectors`` makes from the batches of each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for v in vectors(batches):
            total = v.astype(float) if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"block": [total.tobytes()]})
    return df.mapInArrow(run, SCHEMA).repartition(FAN).mapInArrow(_added, SCHEMA)


def vector_sum(df: DataFrame, size: int, vectors: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]]) -> np.ndarray:
    """The sum on the driver: ``FAN`` vectors of ``size`` doubles reach it. No rows give zeros."""
    total = np.zeros(size)
    for block in blocks(df, vectors).toArrow()["block"].to_pylist():
        total += np.frombuffer(block)
    return total


def columns_of(batch: pa.RecordBatch, columns: list[str], null: float = 0.0) -> np.ndarray:
    """Rows x columns; NULL becomes ``null``."""
    return np.column_stack([batch.column(c).cast(pa.float64()).fill_null(null).to_numpy(zero_copy_only=False) for c in columns])


def _products(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    def run(batches):
        for batch in batches:
            x = columns_of(batch, columns)
            yield (x.T @ x).ravel()
    return run


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X of the columns in one job; a NULL adds nothing to the products it is in."""
    k = len(columns)
    return vector_sum(df.select(*columns), k * k, _products(columns)).reshape(k, k)


def gram_table(df: DataFrame, columns: list[str], names: list[str], sign: float = 1.0) -> DataFrame:
    """(row, col, value) of X'X, upper triangle with diagonal; without rows the values are NULL, as for a sum."""
    k = len(columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(_added(batches))
        m = sign * np.frombuffer(found[0].column("block")[0].as_py()).reshape(k, k) if found else None
        for i in range(k):
            yield pa.RecordBatch.from_pydict({"row": [names[i]] * (k - i), "col": names[i:], "value": pa.array(m[i, i:] if found else [None] * (k - i), pa.float64())})
    return blocks(df.select(*columns), _products(columns)).repartition(1).mapInArrow(rows, "row string, col string, value double")
