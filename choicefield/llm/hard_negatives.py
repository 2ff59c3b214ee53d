"""Hard negatives by coordinate pruning over length buckets.

Inner products are searched exactly. Rows lie in buckets of similar length; a bucket holds for each coordinate a sorted list of the
rows' unit vectors. For an anchor and a score that a row must reach, the length of the bucket bounds the angle between the two, and
that angle bounds every coordinate of the row: the anchor's focus coordinates, its largest, give one range each in the sorted
lists, the candidate sets of the ranges are intersected, and only what is left is scored. Buckets come from long to short, and
the score to reach rises with what was found, from a few rows at the promising end of the first focus list on. A bucket
too short for the score ends the search.

Positives are searched among the rows of the anchor's label, negatives among all rows with the band of each positive as bounds.
Rows are dealt to chunks of bounded size and anchors to blocks of bounded size; a task compares one chunk with one block, so a label
or a vector that a third of all rows share fills many tasks, and the first five of each chunk are merged by a ranked limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, arrow_map, picked

CHUNK = 1 << 14
BLOCK = 1 << 14
BUCKET = 4096
LEAST = 32
FOCUS = 3
TRIED = 32
RATIO = 0.9
SLACK = 1e-9
EXACT = float(1 << 53)


def matrix(vectors: pa.ChunkedArray | pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Stored vectors (int32, or double where they do not fit) as rows of doubles; shorter ones go on with zeros."""
    blobs = vectors.to_pylist()
    if len(sizes) and (sizes == sizes[0]).all() and all(len(b) == 4 * sizes[0] for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), int(sizes[0])).astype(np.float64)
    out = np.zeros((len(blobs), int(sizes.max(initial=0))))
    for row, blob, size in zip(out, blobs, sizes.tolist()):
        row[:size] = np.frombuffer(blob, "<i4" if len(blob) == 4 * size else "<f8")
    return out


def lengths(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, initial=0)
    return top * np.sqrt(((rows / np.where(top, top, 1)[:, None]) ** 2).sum(axis=1))


def unit(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    return rows / np.where(length, length, 1)[:, None]


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where no partial sum can pass 2^53, else in unbounded integers."""
    if np.abs(rows).max(initial=0) * np.abs(anchor).max(initial=0) * len(anchor) < EXACT:
        return (rows @ anchor).astype(np.int64)
    weights = [int(a) for a in anchor]
    out = [sum(int(x) * a for x, a in zip(row, weights)) for row in rows.tolist()]
    if any(abs(s) >= 1 << 63 for s in out):
        raise OverflowError("an inner product does not fit a 64-bit score")
    return np.array(out, np.int64)


class Bucket:
    """Rows of similar length with a sorted list for each coordinate of their unit vectors."""

    def __init__(self, rows: np.ndarray, length: np.ndarray, where: np.ndarray):
        self.rows, self.where, self.longest, self.shortest = rows, where, length[0], length[-1]
        self.units = unit(rows, length)
        self.order = np.argsort(self.units, axis=0, kind="stable")
        self.lists = np.ascontiguousarray(np.take_along_axis(self.units, self.order, axis=0).T)

    def reach(self, score: float, length: float) -> float:
        """The least cosine with which a row can reach ``score``; above 1 no row can."""
        if score > 0:
            most = length * self.longest
            return score / most - SLACK if most > 0 else 2.0
        least = length * self.shortest
        return 0.0 - SLACK if score == 0 else max(-1.0, score / least - SLACK) if least > 0 else -1.0

    def promising(self, focus: np.ndarray, direction: np.ndarray) -> np.ndarray:
        """A few rows at the end of the first focus list where the product with the anchor is largest."""
        if not len(focus):
            return np.arange(min(TRIED, len(self.where)))
        f = focus[0]
        return self.order[-TRIED:, f] if direction[f] > 0 else self.order[:TRIED, f]

    def candidates(self, focus: np.ndarray, direction: np.ndarray, cosine: float) -> np.ndarray:
        """Rows in the ranges of all focus coordinates: the angle to an axis differs by at most the angle to the anchor."""
        angle = np.arccos(max(-1.0, min(1.0, cosine)))
        to_axis = np.arccos(np.clip(direction[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, to_axis + angle)) - SLACK
        high = np.cos(np.maximum(0, to_axis - angle)) + SLACK
        ends = [(np.searchsorted(self.lists[f], a), np.searchsorted(self.lists[f], b, "right")) for f, a, b in zip(focus, low, high)]
        if not ends:
            return np.arange(len(self.where))
        first = min(range(len(ends)), key=lambda i: ends[i][1] - ends[i][0])
        rows = self.order[ends[first][0]:ends[first][1], focus[first]]
        for i, f in enumerate(focus):
            if i != first and len(rows):
                x = self.units[rows, f]
                rows = rows[(x >= low[i]) & (x <= high[i])]
        return rows


def buckets(rows: np.ndarray) -> list[Bucket]:
    """From long to short; a bucket ends where rows get shorter than ``RATIO`` of its longest, or when it is full."""
    length = lengths(rows)
    order = np.argsort(-length, kind="stable")
    out, start = [], 0
    while start < len(order):
        here = length[order[start:start + BUCKET]]
        n = max(min(LEAST, len(here)), int((here >= RATIO * here[0]).sum()))
        part = order[start:start + n]
        out.append(Bucket(rows[part], length[part], part))
        start += n
    return out


class Best:
    """The first ``k`` rows with a score from ``low`` to ``high``: larger scores, then smaller ids."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def needed(self) -> float:
        """A row with less changes nothing."""
        return self.scores[-1] if len(self.scores) == self.k else self.low

    def add(self, found: np.ndarray, ids: np.ndarray) -> None:
        good = (found >= self.needed()) & (found <= self.high)
        s, i = np.concatenate((self.scores, found[good])), np.concatenate((self.ids, ids[good]))
        order = np.lexsort((i, -s))[:self.k]
        self.scores, self.ids = s[order], i[order]


def search(index: list[Bucket], anchor: np.ndarray, length: float, wanted: list[Best], ids: np.ndarray, allowed: np.ndarray) -> None:
    """Fill ``wanted`` from the rows that are ``allowed``."""
    direction = anchor / length if length else anchor
    focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS] if length else np.empty(0, np.int64)
    for i, bucket in enumerate(index):
        rows = np.empty(0, np.int64)
        if not i:
            rows = bucket.promising(focus, direction)
            take(bucket, rows, anchor, wanted, ids, allowed)
        need = min(best.needed() for best in wanted)
        cosine = bucket.reach(need, length)
        if cosine > 1:
            if need > 0:
                break
            continue
        found = bucket.candidates(focus, direction, cosine)
        take(bucket, found[~np.isin(found, rows)] if len(rows) else found, anchor, wanted, ids, allowed)


def take(bucket: Bucket, rows: np.ndarray, anchor: np.ndarray, wanted: list[Best], ids: np.ndarray, allowed: np.ndarray) -> None:
    """Exact verification."""
    rows = rows[allowed[bucket.where[rows]]]
    if len(rows):
        found, own = scores(bucket.rows[rows], anchor), ids[bucket.where[rows]]
        for best in wanted:
            best.add(found, own)


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple:
    sizes = [t["d"].to_numpy() for t in (anchors, rows)]
    a, r = matrix(anchors["v"], sizes[0]), matrix(rows["v"], sizes[1])
    width = max(a.shape[1], r.shape[1])
    a, r = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, r))
    return a, lengths(a), buckets(r), rows["vec_id"].to_numpy(), rows["label"].to_numpy()


def _positives(k: int):
    schema = pa.schema([("key", pa.string()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        a, length, index, ids, _ = _sides(anchors, rows)
        out: list[list] = [[], [], []]
        for key, own, vector, size in zip(anchors["key"].to_pylist(), anchors["vec_id"].to_pylist(), a, length):
            best = Best(k, -np.inf, np.inf)
            search(index, vector, size, [best], ids, ids != own)
            out[0] += [key] * len(best.ids)
            out[1] += best.scores.tolist()
            out[2] += best.ids.tolist()
        return pa.table(dict(zip(schema.names, out)), schema=schema)
    return run


def _negatives(k: int, share: tuple[int, int]):
    schema = pa.schema([("key", pa.string()), ("place", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return schema.empty_table()
        a, length, index, ids, labels = _sides(anchors, rows)
        out: list[list] = [[], [], [], []]
        for key, label, positives, vector, size in zip(anchors["key"].to_pylist(), anchors["label"].to_pylist(), anchors["positive_scores"].to_pylist(), a, length):
            bands = {p: Best(k, -(-share[0] * p // share[1]), p) for p in positives if p >= 0}
            if not bands:
                continue
            search(index, vector, size, list(bands.values()), ids, labels != label)
            for place, p in enumerate(positives):
                best = bands.get(p)
                if best is not None:
                    out[0] += [key] * len(best.ids)
                    out[1] += [place] * len(best.ids)
                    out[2] += best.scores.tolist()
                    out[3] += best.ids.tolist()
        return pa.table(dict(zip(schema.names, out)), schema=schema)
    return run


def _whole_rows(batch: pa.RecordBatch, scale: float) -> Iterator[dict]:
    """Rows that take part, with floor(scale * x) of their components as bytes."""
    vectors = batch.column("vector")
    flat = vectors.flatten().cast(pa.float64())
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(scale * flat.to_numpy(zero_copy_only=False))
    ends = np.cumsum(np.asarray(vectors.value_lengths().fill_null(0)))
    out: dict[str, list] = {"vec_id": [], "label": [], "d": [], "v": []}
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    wide = np.concatenate(([0], np.cumsum(~(np.abs(values) < 2 ** 31))))
    start = 0
    for i, l, valid, end in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), vectors.is_valid().to_pylist(), ends.tolist()):
        if valid and bad[end] == bad[start]:
            part = values[start:end]
            out["vec_id"].append(i)
            out["label"].append(l)
            out["d"].append(end - start)
            out["v"].append(part.astype("<i4" if wide[end] == wide[start] else "<f8").tobytes())
        start = end
    yield out


def whole_vectors(df: DataFrame, label: Column, scale: float) -> DataFrame:
    """(vec_id, label, d, v) of the rows that take part, each once."""
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    return arrow_map(rows.filter("vec_id is not null and label is not null and vector is not null"), _whole_rows,
                     "vec_id bigint, label bigint, d int, v binary", scale).distinct()


def hard_negatives(df: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", relabel: Column | None = None,
                   n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100), scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(scale * x); larger ones come first, ties by the smaller id. The positives of an anchor (a row
    for which ``is_anchor`` on the column ``vec_id`` holds) are its first ``n_positives`` other rows of its label; for each, its
    negatives are the first ``n_negatives`` rows of other labels with share[0] * positive <= share[1] * negative <= share[1] *
    positive. ``relabel``, on ``vec_id`` and ``label``, gives the label to use.

    Rows with a null id, label or vector, or a null or non-finite component (after scaling) take no part. Rows equal in id, label
    and vector count once; rows that share only an id are rows of their own, but never each other's positive. A vector with fewer
    components than another goes on with zeros. An empty table gives no rows; other columns are not read. An inner product beyond
    64 bits raises an error.
    """
    given = picked(df, vec_id=vec_id, vector=embedding, label=label)
    stored = Stored(whole_vectors(given, F.col("label") if relabel is None else relabel, scale), "vectors")
    key = F.sha2(F.concat_ws(" ", "vec_id", "label", F.base64("v")), 256)
    anchors = stored.df.filter(is_anchor).withColumn("key", key)
    dealt = lambda of, n: F.pmod(F.xxhash64(of), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    labels = (stored.df.groupBy("label").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.ceil(F.count_if(is_anchor) / BLOCK).cast("int").alias("blocks"))
              .filter("blocks > 0"))
    cell = ["label", "chunk", "block"]
    asked = anchors.join(labels, "label").withColumn("block", dealt("key", F.col("blocks"))).withColumn("chunk", upto(F.col("chunks")))
    held = stored.df.join(labels, "label").withColumn("chunk", dealt("vec_id", F.col("chunks"))).withColumn("block", upto(F.col("blocks")))
    found = (asked.select(*cell, "key", "vec_id", "d", "v").groupBy(*cell).cogroup(held.select(*cell, "vec_id", "d", "v").groupBy(*cell))
             .applyInArrow(_positives(n_positives), "key string, score bigint, vec_id bigint"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    first = found.withColumn("place", place).filter(F.col("place") <= n_positives)
    positives = Stored(first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("positives")), "positives").df

    total, n_anchors = stored.df.agg(F.count("*"), F.count_if(is_anchor)).first()
    chunks, blocks = max(1, -(-total // CHUNK)), max(1, -(-n_anchors // BLOCK))
    cell = ["chunk", "block"]
    asked = (anchors.join(positives, "key").withColumn("block", dealt("key", F.lit(blocks))).withColumn("chunk", upto(F.lit(chunks)))
             .select(*cell, "key", "label", "d", "v", F.col("positives.score").alias("positive_scores")))
    held = stored.df.withColumn("chunk", dealt("vec_id", F.lit(chunks))).withColumn("block", upto(F.lit(blocks))).select(*cell, "vec_id", "label", "d", "v")
    found = (asked.groupBy(*cell).cogroup(held.groupBy(*cell))
             .applyInArrow(_negatives(n_negatives, share), "key string, place int, score bigint, vec_id bigint"))
    rank = F.row_number().over(Window.partitionBy("key", "place").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= n_negatives)
    named = anchors.select("key", F.col("vec_id").alias("anchor_id")).join(positives, "key").select("key", "anchor_id", F.posexplode("positives").alias("place", "p"))
    return best.join(named, ["key", "place"]).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
