"""Many conditional logits over one design: every model takes its Newton step in the same job.

Each model uses some columns of the design. Their parameter vectors form one small table (model x column, 0 where a model lacks the
column), so utilities of all models are one matrix product per Arrow batch, and each model's log-likelihood, gradient and exact
Hessian come from the same pass over the rows. Rows lie sorted by choice set; a set that goes on in the next batch is carried as
its sums (maximum, sum of exponentials, first and second moments), and a set above the hot limit is spread over salts, whose
sums are added up in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import has_hot_group
from ..operators import blocks, kernels
from .joint import LOG_PROB
from .newton import Fit, Point, maximise_together

SLICE = 1 << 20


class Sets:
    """Sums over choice sets for M parameter vectors (M x A); ``total`` is [sets, per vector: ll, gradient, information]."""

    def __init__(self, betas: np.ndarray, partial: bool = False):
        self.betas, self.partial = betas, partial
        self.m, self.a = betas.shape
        self.sets = 0
        self.ll, self.g, self.info = np.zeros(self.m), np.zeros((self.m, self.a)), np.zeros((self.m, self.a, self.a))
        self.open: tuple | None = None  # (name, top, s, t, q)
        self.out: list[tuple] = []

    def feed(self, name: np.ndarray, d: np.ndarray) -> None:
        if not len(name):
            return
        v = d @ self.betas.T
        starts = np.concatenate(([0], np.flatnonzero(np.diff(name)) + 1))
        sizes = np.diff(np.append(starts, len(name)))
        top = np.maximum.reduceat(v, starts, axis=0)
        e = np.exp(v - np.repeat(top, sizes, axis=0))
        # the first and the last set may have rows in other batches: they are carried; those between are complete
        self._carry(name[0], top[0], e[:sizes[0]], d[:sizes[0]])
        if len(starts) > 1:
            self._end()
            first, last = starts[1], starts[-1]
            if last > first:
                if self.partial:
                    for k in range(1, len(starts) - 1):
                        self._carry(name[starts[k]], top[k], e[starts[k]:starts[k + 1]], d[starts[k]:starts[k + 1]])
                        self._end()
                else:
                    self._whole(top[1:-1], e[first:last], d[first:last], starts[1:-1] - first, sizes[1:-1])
            self._carry(name[-1], top[-1], e[last:], d[last:])

    def _carry(self, name, top: np.ndarray, e: np.ndarray, d: np.ndarray) -> None:
        s, t = e.sum(axis=0), e.T @ d
        q = np.stack([(d * e[:, i, None]).T @ d for i in range(self.m)])
        self.add(name, top, s, t, q)

    def add(self, name, top: np.ndarray, s: np.ndarray, t: np.ndarray, q: np.ndarray) -> None:
        """Sums of some rows of a set, with exponentials relative to ``top``."""
        if self.open is not None and self.open[0] != name:
            self._end()
        if self.open is not None:
            _, top0, s0, t0, q0 = self.open
            most = np.maximum(top0, top)
            was, now = np.exp(top0 - most), np.exp(top - most)
            top, s, t, q = most, was * s0 + now * s, was[:, None] * t0 + now[:, None] * t, was[:, None, None] * q0 + now[:, None, None] * q
        self.open = name, top, s, t, q

    def _end(self) -> None:
        if self.open is None:
            return
        name, top, s, t, q = self.open
        self.open = None
        if self.partial:
            self.out.append((name, np.concatenate((top, s, t.ravel(), q.ravel()))))
            return
        mean = t / s[:, None]
        self.sets += 1
        self.ll += np.clip(-(np.log(s) + top), *LOG_PROB)
        self.g -= mean
        self.info += q / s[:, None, None] - mean[:, :, None] * mean[:, None, :]

    def _whole(self, top, e, d, starts, sizes) -> None:
        s = np.add.reduceat(e, starts, axis=0)
        w = e / np.repeat(s, sizes, axis=0)
        self.sets += len(starts)
        self.ll += np.clip(-(np.log(s) + top), *LOG_PROB).sum(axis=0)
        for i in range(self.m):
            rows = d * w[:, i, None]
            mean = np.add.reduceat(rows, starts, axis=0)
            self.g[i] -= mean.sum(axis=0)
            self.info[i] += rows.T @ d - mean.T @ mean

    def total(self) -> np.ndarray:
        self._end()
        return np.concatenate([[self.sets], *[np.concatenate(([self.ll[i]], self.g[i], self.info[i].ravel())) for i in range(self.m)]])


def _batches(batches: Iterator[pa.RecordBatch], a: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = max(1, SLICE // m)
    for whole in batches:
        for batch in (whole.slice(i, size) for i in range(0, len(whole), size)):
            yield batch.column("sid").to_numpy(), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, a)


class Design:
    """The rows of a relative design, kept sorted by choice set; sets above the hot limit apart, over salts."""

    def __init__(self, rel: DataFrame, set_keys: list[str], columns: list[str]):
        self.columns = columns
        rows = rel.select(F.xxhash64(*set_keys).alias("sid"), F.array(*[F.col(f"d_{c}") for c in columns]).alias("x"))
        self.hot = None
        if has_hot_group(rel, set_keys):
            from ..functions import groups
            many = rows.groupBy("sid").count().filter(F.col("count") > groups.HOT_ROWS).select("sid")
            salted = rows.join(many, "sid", "left_semi").withColumn("salt", F.pmod(F.xxhash64("x", F.lit(1)), F.lit(groups.RANGES)).cast("int"))
            self.hot = self._kept(salted, ["sid", "salt"])
            rows = rows.join(many, "sid", "left_anti")
        self.rows = self._kept(rows, ["sid"])

    @staticmethod
    def _kept(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by).select("sid", "x").persist(StorageLevel.MEMORY_AND_DISK)

    def drop(self) -> None:
        for df in (self.rows, self.hot):
            if df is not None:
                df.unpersist()

    def points(self, betas: np.ndarray) -> tuple[int, list[Point]]:
        """Number of sets, and the point of each parameter vector (a row of ``betas``)."""
        m, a = betas.shape
        size = 1 + m * (1 + a + a * a)

        def sums(batches):
            kernel = Sets(betas)
            for piece in _batches(batches, a, m):
                kernel.feed(*piece)
            yield kernel.total()

        def pieces(batches):
            kernel = Sets(betas, partial=True)
            for piece in _batches(batches, a, m):
                kernel.feed(*piece)
                yield from ready(kernel)
            kernel._end()
            yield from ready(kernel)

        def ready(kernel):
            if kernel.out:
                yield pa.RecordBatch.from_pydict({"sid": [int(n) for n, _ in kernel.out], "sums": [v.tobytes() for _, v in kernel.out]})
                kernel.out.clear()

        def merged(batches):
            kernel = Sets(betas)
            for batch in batches:
                for name, block in zip(batch.column("sid").to_pylist(), batch.column("sums").to_pylist()):
                    v = np.frombuffer(block)
                    kernel.add(name, v[:m], v[m:2 * m], v[2 * m:2 * m + m * a].reshape(m, a), v[2 * m + m * a:].reshape(m, a, a))
            yield kernel.total()
        total = blocks.vector_sum(self.rows, size, sums)
        if self.hot is not None:
            parts = self.hot.mapInArrow(pieces, "sid bigint, sums binary").repartition("sid").sortWithinPartitions("sid")
            total = total + blocks.vector_sum(parts, size, merged)
        per = total[1:].reshape(m, 1 + a + a * a)
        return int(total[0]), [Point(float(t[0]), t[1:1 + a], t[1 + a:].reshape(a, a)) for t in per]


def fit_together(rel: DataFrame, set_keys: list[str], models: dict[str, list[str]], max_iter: int = 50) -> dict[str, Fit]:
    """Conditional logits (name -> columns of the relative design) by Newton steps, one job a step for all that are not done."""
    columns = list(dict.fromkeys(c for use in models.values() for c in use))
    design = Design(rel, set_keys, columns)
    at = {name: [columns.index(c) for c in use] for name, use in models.items()}
    n_sets = 0

    def evaluate(thetas: dict[str, np.ndarray]) -> dict[str, Point]:
        nonlocal n_sets
        betas = np.zeros((len(thetas), len(columns)))
        for row, (name, theta) in zip(betas, thetas.items()):
            row[at[name]] = theta
        n_sets, points = design.points(betas)
        return {name: Point(p.ll, p.gradient[at[name]], p.information[np.ix_(at[name], at[name])]) for name, p in zip(thetas, points)}
    fits = maximise_together(models, evaluate, max_iter)
    for fit in fits.values():
        fit.n_obs, fit.null_ll = n_sets, fit.trace[0][1]
    design.drop()
    return fits
