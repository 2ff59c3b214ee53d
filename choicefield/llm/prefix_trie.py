"""Prefix trie of conversations by truncation peeling.

A conversation truncated to its first d turns stands for a node at depth d: two with the same turns are one node. Peeling descends
from the deepest nodes: conversations that end at a node are merged with those that survive from below, the node adds itself to
what it carries (leaves, saved tokens), its last turn is stripped, and what is left is regrouped. Turns are told apart by a
position-bound 128-bit sum of their SHA-256, a running sum along a conversation, so texts never leave their scan.

Regrouping turn by turn would be one job for each turn of the longest conversation, and most of them would regroup nothing. So
the last turns that the same conversations share, a run, are stripped at once: a run ends where a conversation ends or leaves.
There are as many rounds as there are runs on the longest path, and each handles one row a run, added up before it is shuffled.
Within a run all nodes have the same conversations and leaves, and saved tokens follow from a running sum of lengths.

No group is held in one task: counts, minima and sums are partially combined, a conversation with very many turns is cut into
ranges (``functions.groups``), and the ids that end at one node are joined to pieces by ranges before one task hashes the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import has_hot_group, ordered_scan
from .common import Stored, picked

SHARED = 100
CUTS = 6
PIECE = 1 << 16
NO_ENDS = sha256(b"").hexdigest()


def decimal_crc(c: Column) -> Column:
    """Unsigned CRC-32 of the decimal number."""
    return F.crc32(F.encode(c.cast("string"), "utf-8"))


def turns_of(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, digest, n): one row per turn with the SHA-256 of role and text and the code points of the text."""
    rows = picked(df, c=conv_id, turn=turn, role=role, text=text).filter("c is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return rows.select(F.col("c").cast("bigint").alias("c"), F.col("turn").isNotNull().alias("given"),
                       F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
                       F.unhex(F.sha2(F.encode(whole, "utf-8"), 256)).alias("digest"), F.length(text).cast("bigint").alias("n"))


def numbered(rows: DataFrame) -> DataFrame:
    """(c, i, digest, n): turns numbered from 1; without a turn number first, equal numbers by digest."""
    total = ordered_scan(rows, ["c"], ["given", "turn", "digest"], number="i")
    return total.select("c", "i", "digest", "n")


def rebuilt(own: DataFrame) -> DataFrame:
    """(c, d, digest, n): every conversation with its first h turns replaced by those of the first of its hundred."""
    h = F.pmod(decimal_crc(F.col("c")), F.lit(CUTS))
    base = F.col("c") - F.col("c") % SHARED
    heads = (own.filter((F.col("c") % SHARED == 0) & (F.col("i") < CUTS)).groupBy(F.col("c").alias("b"))
             .agg(F.array_sort(F.collect_list(F.struct("i", "digest", "n"))).alias("head")))  # at most five turns
    all_ = own.select("c").distinct().withColumn("h", h).withColumn("b", base).join(heads, "b", "left")
    taken = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    begun = all_.select("c", F.explode(taken).alias("t")).select("c", F.col("t.i").cast("bigint").alias("d"), "t.digest", "t.n")
    sizes = heads.select("b", F.size("head").alias("m"))
    later = own.withColumn("h", h).withColumn("b", base).filter("i > h").join(sizes, "b", "left")
    kept = F.least(F.col("h"), F.coalesce("m", F.lit(0)))
    return begun.unionByName(later.select("c", (F.col("i") - F.col("h") + kept).alias("d"), "digest", "n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, x, y, n): x and y identify the first d turns."""
    part = lambda seed: F.xxhash64(F.lit(seed), "d", "digest").cast("decimal(38,0)")
    rows = turns.select("c", "d", "n", part(1).alias("x1"), part(2).alias("y1"))
    return ordered_scan(rows, ["c"], ["d"], run_sum={"x": "x1", "y": "y1"}).select("c", "d", "x", "y", "n")


def runs_and_nodes(at: DataFrame) -> DataFrame:
    """One row per node, that of its smallest conversation: (c, d, n, members, parent, level, stop).

    ``at`` has (c, d, n, members, smallest) for every prefix of every conversation. ``level`` counts the runs down to the node,
    ``stop`` says that its run ends with it: one of its conversations ends or leaves there.
    """
    split = has_hot_group(at, ["c"])
    down = ordered_scan(at.withColumn("up", -F.col("d")), ["c"], ["up"], lag={"next": "members"}, split=split)
    marked = down.withColumn("stop", ~F.col("next").eqNullSafe(F.col("members")))
    marked = marked.withColumn("stopped", F.col("stop").cast("bigint")).drop("next", "up")
    along = ordered_scan(marked, ["c"], ["d"], lag={"parent": "smallest"}, run_sum={"runs": "stopped", "total": "n"}, split=split)
    return along.withColumn("level", F.col("runs") - F.col("stopped") + 1).filter("c = smallest").select(
        "c", "d", "n", "members", "parent", "level", "stop", "total")


def peeled(runs: DataFrame, root: int) -> DataFrame:
    """(c, level, leaves, below, children) of every run (c, level, up, weight): what its last node carries from below.

    ``up`` is the smallest conversation of the node above the run and ``weight`` what the run's nodes save. From the deepest level
    up: the runs of a level are merged with what survived below, give their sum to the run above and are stripped.
    """
    deepest = runs.agg(F.max("level")).first()[0] or 0
    done, alive = [], None
    for level in range(deepest, 0, -1):
        here = runs.filter(F.col("level") == level)
        if alive is not None:
            below = alive.groupBy(F.col("up").alias("c")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"), F.count("*").alias("children"))
            here = here.join(below, "c", "left")
        else:
            here = here.withColumns({k: F.lit(None).cast("bigint") for k in ("leaves", "below", "children")})
        step = here.select("c", "level", "up", F.coalesce("leaves", F.lit(1)).cast("bigint").alias("leaves"), F.coalesce("below", F.lit(0)).cast("bigint").alias("below"),
                           F.coalesce("children", F.lit(0)).cast("bigint").alias("children"), (F.coalesce("below", F.lit(0)) + F.col("weight")).alias("saved"))
        alive = Stored(step, f"level{level}").df
        done.append(alive)
    top = (alive.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"), F.count("*").alias("children")) if alive is not None else
           runs.sparkSession.range(1).select(F.lit(1).alias("leaves"), F.lit(0).alias("below"), F.lit(0).alias("children")))
    out = top.select(F.lit(root).cast("bigint").alias("c"), F.lit(0).alias("level"), "leaves", "below", "children")
    for step in done:
        out = out.unionByName(step.select("c", "level", "leaves", "below", "children"))
    return out.select("c", *[F.col(k).cast("bigint").alias(k) for k in ("level", "leaves", "below", "children")])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, d, member) in order -> (c, d, first, ids): neighbours of one node joined up to ``PIECE`` ids."""
    out: list[list] = []

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"c": [o[0] for o in out], "d": [o[1] for o in out], "first": [o[2][0] for o in out], "ids": [",".join(map(str, o[2])) for o in out]})

    for batch in batches:
        for c, d, member in zip(*[batch.column(k).to_pylist() for k in ("c", "d", "member")]):
            if out and out[-1][0] == c and out[-1][1] == d and len(out[-1][2]) < PIECE:
                out[-1][2].append(member)
            else:
                out.append([c, d, [member]])
        if len(out) > 1:
            last = out.pop()
            yield ready()
            out = [last]
    if out:
        yield ready()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (c, d, first, ids) in order -> (c, d, ends_sha256); of a node only its running hash is held."""
    node, running = None, None
    for batch in batches:
        done: list[tuple] = []
        for c, d, ids in zip(*[batch.column(k).to_pylist() for k in ("c", "d", "ids")]):
            if node == (c, d):
                running.update(b"," + ids.encode())
            else:
                if node:
                    done.append((*node, running.hexdigest()))
                node, running = (c, d), sha256(ids.encode())
        yield pa.RecordBatch.from_pydict({"c": pa.array([o[0] for o in done], pa.int64()), "d": pa.array([o[1] for o in done], pa.int64()),
                                          "ends_sha256": pa.array([o[2] for o in done], pa.string())})
    if node:
        yield pa.RecordBatch.from_pydict({"c": [node[0]], "d": [node[1]], "ends_sha256": [running.hexdigest()]})


def end_digests(ends: DataFrame) -> DataFrame:
    """(c, d, ends_sha256) of the conversations (member) that end at each node (c, d)."""
    pieces = (ends.repartitionByRange("c", "d", "member").sortWithinPartitions("c", "d", "member")
              .mapInArrow(_pieces, "c bigint, d bigint, first bigint, ids string"))
    return (pieces.repartition("c", "d").sortWithinPartitions("c", "d", "first")
            .mapInArrow(_hashes, "c bigint, d bigint, ends_sha256 string"))


def prefix_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Conversations are rebuilt first (``rebuilt``). Rows without a conversation id belong to none. Turns without a number come
    first; turns with the same number, repeated rows too, are all turns, ordered by the digest of role and text. Null roles and
    texts are empty. An empty table has no conversation and so no node, not even a root. Other columns are not read.
    """
    own = Stored(numbered(turns_of(df, conv_id, turn, role, text)), "turns")
    ids = own.df.select("c").distinct()
    root, everyone = ids.agg(F.min("c"), F.count("*")).first()
    at = Stored(prefixes(rebuilt(own.df)), "prefixes")
    groups = at.df.groupBy("d", "x", "y").agg(F.min("c").alias("smallest"), F.count("*").alias("members"))
    marked = Stored(at.df.join(groups, ["d", "x", "y"]).select("c", "d", "n", "members", "smallest"), "marked")
    nodes = Stored(runs_and_nodes(marked.df), "nodes")
    # a run by its level and smallest conversation, which is that of all its nodes
    runs = Stored(nodes.df.groupBy("c", "level").agg(
        F.min_by("parent", "d").alias("up"), F.max("d").alias("bottom"), F.max("total").alias("total"),
        F.sum((F.col("members") - 1) * F.col("n")).alias("weight")).withColumn("up", F.coalesce("up", F.lit(root).cast("bigint"))), "runs")
    carried = peeled(runs.df.select("c", "level", "up", "weight"), root)
    last = marked.df.groupBy("c").agg(F.max("d").alias("d"), F.max_by("smallest", "d").alias("smallest"))
    ends = ids.join(last, "c", "left").select(F.coalesce("smallest", F.lit(root)).alias("c"), F.coalesce("d", F.lit(0)).cast("bigint").alias("d"), F.col("c").alias("member"))
    whole = nodes.df.join(runs.df.select("c", "level", "bottom", F.col("total").alias("sum")), ["c", "level"]).join(carried, ["c", "level"])
    here = (F.col("members") - 1) * (F.col("sum") - F.col("total") + F.col("n"))
    rows = whole.select("c", "d", F.coalesce("parent", F.lit(root)).alias("parent_conv_id"), F.col("members").alias("n_convs"),
                        F.when(F.col("d") < F.col("bottom"), 1).otherwise(F.col("children")).cast("bigint").alias("n_children"),
                        F.col("leaves").alias("n_leaves"), (F.col("below") + here).alias("saved_tokens"))
    top = carried.filter("level = 0").select(
        "c", F.lit(0).cast("bigint").alias("d"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(everyone).cast("bigint").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("below").alias("saved_tokens"))
    out = rows.unionByName(top.filter(F.lit(everyone > 0))).join(end_digests(ends), ["c", "d"], "left")
    return out.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
