"""Best-fit packing of tokenised documents into sequences of a fixed length, planned on length counts alone.

Each document is its token ids and an end sign. Longer ones are cut so that only the first piece is shorter than a sequence.
What is left to pack is one number for each length below the capacity: how many pieces have it. Exact complements come first:
for each length from the longest, one other length, then two, then three, that fill the gap exactly and are still available, as
often as counts allow. The rest is placed best-fit decreasing, on counts too; as it needs short pieces to fill gaps, plans that
keep a share of them from the exact steps, or take no three, are made as well, and the one with the fewest sequences is used. The plan has a bounded number of rows whatever the corpus:
each exact step uses up a length, and best fit opens a class of sequences at most a few times per length.

In Spark, texts are tokenised once into a stored table; a piece's rank within its length comes from counts per (length, salt)
and a row number within that pair, so that a length with very many pieces is spread; a join on length and rank range gives
its sequence and place.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Chunks
from .common import Stored, arrow_map, hold, picked, text_slices

CAPACITY = 1024
END = 2
SALTS = 64
RESERVES = (0.0, 0.1, 0.3, 0.5)

PlanRow = tuple[int, int, int, int, int]
_READY: dict[str, Chunks] = {}


def _chunks(path: str) -> Chunks:
    """One tokenizer and its known pieces for each Python worker."""
    hold(__name__, _READY.clear)
    if path not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        tokenizer.no_padding()
        tokenizer.no_truncation()

        sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            sizes[i] = len(token)  # a byte-level vocabulary writes each byte as one sign
        _READY[path] = Chunks(lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), sizes)
    return _READY[path]


def _token_rows(batch: pa.RecordBatch, path: str, capacity: int, end: int, numbers: Iterator[int]) -> Iterator[dict]:
    chunks, tail = _chunks(path), np.array([end], "<u4").tobytes()
    for part in text_slices(batch):
        lengths, crcs = [], []
        for ids in chunks.texts([t or "" for t in part.column("text").to_pylist()]):
            ids += tail
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            lengths.append(n)
            crcs.append([zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(cuts, cuts[1:])])
        yield {"doc_id": part.column("doc_id"), "n": lengths, "crcs": crcs, "salt": [next(numbers) % SALTS for _ in lengths]}


def exact_steps(left: Counter, capacity: int, most: int = 3) -> Iterator[tuple[tuple[int, ...], int]]:
    """(lengths, times) of combinations of a length and up to ``most`` others that fill a sequence exactly; takes them out of ``left``.

    Pairs are indexed by their sum, triples are a length and an indexed pair. As ``left`` only shrinks, a pair that is used up
    leaves the index for good; of the pairs of a sum at most two need a length that the combination has already."""
    present = sorted((x for x in left if left[x] > 0), reverse=True)
    sums: dict[int, list[int]] = {}
    for i in range(len(present) - 1, -1, -1):
        for b in reversed(present[i:]):
            if present[i] + b >= capacity:
                break
            sums.setdefault(present[i] + b, []).append(present[i])

    def enough(lengths: tuple[int, ...]) -> bool:
        return all(left[x] >= k for x, k in Counter(lengths).items())

    def pair(total: int, *others: int) -> tuple[int, ...]:
        """``others`` and the pair of this sum with the longest length that is still there besides them."""
        longest = sums.get(total, [])
        for i in range(len(longest) - 1, -1, -1):
            two = (longest[i], total - longest[i])
            if enough(others + two):
                return others + two
            if not enough(two):
                del longest[i]
        return ()

    def filling(long: int) -> tuple[int, ...]:
        gap = capacity - long
        if enough((long, gap)):
            return long, gap
        found = pair(gap, long)
        if found or most < 3:
            return found
        return next(filter(None, (pair(gap - a, long, a) for a in present if a <= gap - 2 and sums.get(gap - a) and left[a])), ())

    for long in present:
        while left[long] and (lengths := filling(long)):
            need = Counter(lengths)
            times = min(left[x] // k for x, k in need.items())
            left.subtract({x: k * times for x, k in need.items()})
            yield lengths, times


def best_fit_steps(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of the sequences that best-fit decreasing makes of what is left, counted in classes of equal content."""
    by_gap: dict[int, list] = {}
    done = []

    def keep(content: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(content)
        if times:
            by_gap.setdefault(gap, []).append([content, times])

    for length in sorted((x for x in left if left[x]), reverse=True):
        todo = left[length]
        while todo:
            gap = min((g for g in by_gap if g >= length and by_gap[g]), default=None)
            if gap is None:
                each = capacity // length
                keep((length,) * each, todo // each)
                keep((length,) * (todo % each), int(todo % each > 0))
                break
            content, times = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
            each = min(gap // length, todo)
            used = min(times, todo // each)
            keep(content, times - used)
            keep(content + (length,) * each, used)
            todo -= used * each
    for classes in by_gap.values():
        done += [(tuple(c), t) for c, t in classes]
    return done


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[PlanRow], int]:
    """Rows (length, first rank, end rank, first sequence, offset) and the number of sequences."""
    def steps(how: tuple[float, int]) -> list[tuple[tuple[int, ...], int]]:
        """Exact steps that leave a share of the short pieces, which best fit needs to fill gaps; then best fit."""
        reserve, most = how
        kept = Counter({x: math.ceil(reserve * c) for x, c in counts.items() if 3 * x <= capacity})
        left = Counter({x: c - kept[x] for x, c in counts.items()})
        exact = list(exact_steps(left, capacity, most))
        left.update(kept)
        return exact + best_fit_steps(left, capacity)

    taken, sequence, rows = Counter(), 0, []
    for lengths, times in min(map(steps, product(RESERVES, (3, 2))), key=lambda made: sum(t for _, t in made)):
        offset = 0
        for x in lengths:
            rows.append((x, taken[x], taken[x] + times, sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    return rows, sequence


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``path`` names a tokenizer file that every executor has. A null text is an empty one and becomes the end sign alone.
    Repeated rows are documents of their own. Pieces of equal length are interchangeable. Sequences made of short pieces are
    numbered from 0; a piece that fills a sequence has a number above those. An empty table gives no rows; other columns are
    not read.
    """
    rows = picked(df, doc_id=doc_id, text=text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n bigint, crcs array<bigint>, salt int"
    docs = Stored(arrow_map(rows, _numbered_rows, schema, path, capacity, end), "lengths").df.withColumn("short", F.col("n") % capacity)
    some = docs.filter("short > 0")
    each = Stored(some.groupBy("short", "salt").agg(F.count("*").alias("c")), "length-counts").df
    counts = {r.short: r.c for r in each.groupBy("short").agg(F.sum("c").alias("c")).collect()}  # below ``capacity`` rows
    planned, sequences = plan(counts, capacity)
    before = each.select("short", "salt", (F.sum("c").over(Window.partitionBy("short").orderBy("salt")) - F.col("c")).alias("before"))
    ranked = (some.withColumn("rank", F.row_number().over(Window.partitionBy("short", "salt").orderBy("doc_id")))
              .join(before, ["short", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before")))
    slots = df.sparkSession.createDataFrame(planned, "length bigint, lo bigint, hi bigint, first bigint, offset bigint")
    placed = (ranked.join(F.broadcast(slots), (F.col("short") == F.col("length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
              .select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.col("short").alias("length"),
                      F.col("crcs")[0].alias("ids_crc32"), (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"))
    lead = (F.col("short") > 0).cast("int")
    whole = (docs.select("doc_id", "short", lead.alias("lead"), F.posexplode("crcs").alias("piece", "ids_crc32")).filter("piece >= lead")
             .select("doc_id", "piece", (F.col("short") + (F.col("piece") - F.col("lead")) * capacity).cast("bigint").alias("start"),
                     F.lit(capacity).cast("bigint").alias("length"), "ids_crc32",
                     (F.monotonically_increasing_id() + sequences).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    return placed.unionByName(whole)


def _numbered_rows(batch: pa.RecordBatch, path: str, capacity: int, end: int) -> Iterator[dict]:
    return _token_rows(batch, path, capacity, end, _NUMBERS)


_NUMBERS = count()
