"""Nearest neighbours by cosine: inverted lists, scanned dimension block by dimension block with early abandonment.

Unit vectors are turned by a random rotation, after which the first d of D dimensions hold about d/D of any squared distance. A
candidate is abandoned as soon as its partial distance, scaled up, exceeds the best known k-th distance by more than a test
allows (``EPSILON`` standard errors); survivors read the next block of columns. Survivors of all blocks get the exact cosine of
the original vectors in double precision.

The rotation, the lists' centres and the share of lists to probe are fitted on at most ``SAMPLE`` vectors; every vector is
indexed. The share is the smallest whose recall on sampled queries reaches ``RECALL`` against brute force, up to all lists.
Equal vectors are one entry with its smallest ids, so copies cost nothing. Lists are cut into chunks of about ``CHUNK`` vectors
and queries into blocks of about ``BLOCK``: a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, arrow_map, column, picked

SAMPLE = 20_000
LISTS = 1024
CHUNK, BLOCK = 16_384, 4096
COLUMNS = 16
EPSILON = 2.1
RECALL = 0.98
SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def matrix(vectors: pa.Array) -> np.ndarray:
    values = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else np.empty((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest entry first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    share: float

    def lists(self, unit: np.ndarray, n: int) -> np.ndarray:
        near = unit @ self.centres.T
        return np.argmax(near, axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]

    @property
    def probes(self) -> int:
        return max(1, int(np.ceil(self.share * len(self.centres))))


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 7) -> Index:
    """Index for a table of ``rows`` vectors from a sample of them."""
    rng = np.random.default_rng(seed)
    unit = units(sample)
    rotation = np.linalg.qr(rng.standard_normal((unit.shape[1], unit.shape[1])))[0]
    count = int(min(LISTS, max(1, np.sqrt(rows)), len(unit)))
    centres = unit[rng.choice(len(unit), count, replace=False)]
    for _ in range(8):
        of = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        full = np.linalg.norm(sums, axis=1) > 0
        centres[full] = units(sums[full])
    index = Index(rotation, centres, 1.0)
    asked = rng.choice(len(unit), min(200, len(unit)), replace=False)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-near, axis=1)[:, :k]
    place = np.argsort(index.lists(unit[asked], count) if count > 1 else np.zeros((len(asked), 1), int), axis=1)
    depth = np.take_along_axis(place, np.argmax(unit @ centres.T, axis=1)[top], axis=1)
    index.share = next(s for s in SHARES if s == 1.0 or (depth < np.ceil(s * count)).mean() >= RECALL)
    return index


def scan(queries: np.ndarray, candidates: np.ndarray, rotation: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate row) of the ``keep`` nearest candidates of each query, by the adaptive scan over unit vectors."""
    q, c = queries @ rotation, candidates @ rotation
    size = c.shape[1]
    blocks = [(a, min(a + COLUMNS, size)) for a in range(0, size, COLUMNS)]
    out_q, out_c = [], []
    first = min(len(c), 256)
    for i, x in enumerate(q):
        best = ((c[:first] - x) ** 2).sum(axis=1)
        rows = np.arange(first)
        for start in range(first, len(c), 4096):
            limit = np.partition(best, keep - 1)[keep - 1] if len(best) >= keep else np.inf
            left = np.arange(start, min(start + 4096, len(c)))
            partial = np.zeros(len(left))
            for a, b in blocks:
                partial = partial + ((c[left, a:b] - x[a:b]) ** 2).sum(axis=1)
                slack = (1 + EPSILON / np.sqrt(b)) ** 2 * b / size if b < size else 1 + 1e-9
                stay = partial <= limit * slack
                left, partial = left[stay], partial[stay]
            best, rows = np.concatenate((best, partial)), np.concatenate((rows, left))
            if len(best) > 8 * keep:
                near = best <= np.partition(best, keep - 1)[keep - 1] * (1 + 1e-9) + 1e-12
                best, rows = best[near], rows[near]
        near = np.flatnonzero(best <= np.partition(best, keep - 1)[keep - 1] * (1 + 1e-9) + 1e-12) if len(best) > keep else np.arange(len(best))
        out_q.append(np.full(len(near), i))
        out_c.append(rows[near])
    return np.concatenate(out_q), np.concatenate(out_c)


def taking_part(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _list_rows(batch: pa.RecordBatch, index, probes: int) -> Iterator[dict]:
    for part in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
        lists = index.value.lists(units(matrix(part.column("vector"))), probes)
        yield {n: part.column(n) for n in part.schema.names} | {"lists": lists.tolist()}


def _cell_search(index, keep: int):
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.binary()), ("c", pa.binary()), ("score", pa.float64())])
        if not len(queries) or not len(entries):
            return schema.empty_table()
        x, y = units(matrix(queries["vector"])), units(matrix(entries["vector"]))
        i, j = scan(x, y, index.value.rotation, keep)
        a, b = matrix(queries["vector"])[i], matrix(entries["vector"])[j]
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
        score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        return pa.table({"q": queries["key"].combine_chunks().take(pa.array(i)), "c": entries["key"].combine_chunks().take(pa.array(j)),
                         "score": score}, schema=schema)
    return run


def search(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row, nearest first, ties to the smaller id.

    ``is_query`` is a condition on the column ``vec_id``. A query is never its own neighbour; with fewer other vectors than ``k`` it
    gets all of them. Vectors that are null, empty, zero or hold a null or a non-finite component take no part, nor do those with
    another number of dimensions than most have, or a null id. Rows that repeat an id and vector count once. An empty table
    gives no rows; other columns are not read.
    """
    spark, keep = df.sparkSession, k + 1
    rows = picked(df, vec_id=vec_id, vector=embedding).filter(F.col("vec_id").isNotNull() & taking_part(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == sizes.d).withColumn(
        "key", F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), "vector")), 16, "0") for i in range(2)])))
    low = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    entries = Stored(rows.distinct().withColumn("r", low).filter(F.col("r") <= keep).groupBy("key").agg(
        F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors").df
    count = entries.count()
    sample = entries.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, 2 * count // SAMPLE))) == 0).select("vector").limit(SAMPLE).toArrow()
    if len(sample) <= k:
        sample = entries.select("vector").limit(SAMPLE).toArrow()
    index = fit(matrix(sample["vector"]), count, k)
    shared = spark.sparkContext.broadcast(index)
    queries = rows.filter(is_query).select("vec_id", "key").distinct()
    asked = entries.join(queries.select("key").distinct(), "key", "left_semi").select("key", "vector")

    fields = "key binary, vector array<double>, lists array<bigint>"
    doubles = F.col("vector").cast("array<double>").alias("vector")
    placed = Stored(arrow_map(entries.select("key", doubles), _list_rows, fields, shared, 1).select("key", "vector", F.col("lists")[0].alias("list")), "lists")
    blocks = max(1, -(-asked.count() // BLOCK))
    cells = placed.df.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # at most LISTS rows
    def part(of: str | int) -> Column:
        return F.pmod(F.xxhash64("key"), F.col(of) if isinstance(of, str) else F.lit(of)).cast("int")

    near = (arrow_map(asked.select("key", doubles), _list_rows, fields, shared, index.probes)
            .withColumn("block", part(blocks)).withColumn("list", F.explode("lists")).join(F.broadcast(cells), "list")
            .select("key", "vector", "list", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
    held = (placed.df.join(F.broadcast(cells), "list").withColumn("chunk", part("chunks"))
            .select("key", "vector", "list", "chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))
    cell = ["list", "chunk", "block"]
    found = near.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(_cell_search(shared, keep), "q binary, c binary, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
    best = (found.join(entries.select(F.col("key").alias("c"), "ids"), "c").withColumn("r", F.row_number().over(order))
            .filter(F.col("r") <= keep).select("q", "ids", "score"))
    pairs = (queries.withColumnRenamed("vec_id", "query_id").join(best, F.col("key") == F.col("q"))
             .select("query_id", "key", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("query_id").cast("bigint"), "rank", F.col("vec_id").cast("bigint"), "score")
