"""Helpers that several operators share: column picking, Arrow maps, stored steps, components of a link table."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path

TEXT_BLOCK = 1 << 20
FILTER_BITS = 1 << 26
SMALL = 32
CENTRES = (1, 8, 32)
FIRST = 4
LISTED = 32


def column(name: str) -> Column:
    """The column of exactly this name, dots and other signs included."""
    return F.col("`" + name.replace("`", "``") + "`")


def picked(df: DataFrame, **roles: str) -> DataFrame:
    """Only the columns that an operator needs, under its own names; extra columns cannot clash with what it adds."""
    return df.select(*[column(source).alias(role) for role, source in roles.items()])


class Stored:
    """A step written once to the shared folder: lineage is cut and lost executors cost no recomputation. ``drop`` removes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, fresh_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.schema = df.schema
        if _SCOPES:
            _SCOPES[-1].made.append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_SCOPES: list[Scope] = []


class Scope:
    """Removes the steps stored within it when it ends, but those kept; these belong to the scope around it, if there is one."""

    def __enter__(self) -> Scope:
        self.made, self.kept = [], []
        _SCOPES.append(self)
        return self

    def keep(self, *steps: Stored) -> None:
        self.kept += steps

    def __exit__(self, *_) -> None:
        _SCOPES.remove(self)
        for step in self.made:
            if step not in self.kept:
                step.drop()
        if _SCOPES:
            _SCOPES[-1].made += self.kept


def arrow_map(df: DataFrame, rows: Callable[..., Iterable[dict]], schema: str, *args) -> DataFrame:
    """``rows(batch, *args)`` turns one Arrow batch into dicts of equally long columns; ``schema`` is a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(rows.__module__)
        for batch in batches:
            for out in rows(batch, *args):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_MEMORIES: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Python workers are used again by later stages: an operator that starts there drops what others remembered, and gives the
    memory back."""
    others = [n for n in _MEMORIES if n != owner]
    for name in others:
        _MEMORIES.pop(name)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    if clear:
        _MEMORIES[owner] = clear


def text_slices(batch: pa.RecordBatch, name: str = "text", limit: int = TEXT_BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes of text (a longer text is alone), to bound memory."""
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def bit_filter(wanted: DataFrame, key: str, mixed: bool = False) -> tuple[int, np.ndarray]:
    """(bits, 64-bit words) of a filter of two bits for each key, at most ``FILTER_BITS`` long: it lets every wanted key pass,
    and few others while there are fewer keys than a sixteenth of its bits. ``mixed`` keys are hashes themselves."""
    bits = min(FILTER_BITS, 1 << max(10, (16 * wanted.count()).bit_length()))
    h = F.col(key) if mixed else F.xxhash64(key)
    at = F.explode(F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)))
    words = (wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return bits, out


def filtered(batch: pa.RecordBatch, picks: tuple[int, np.ndarray] | None) -> pa.RecordBatch:
    """The rows whose ``filter_hash`` (xxhash64 of the key) passes the filter."""
    return batch if picks is None else batch.filter(pa.array(passing(batch.column("filter_hash").to_numpy().view(np.uint64), picks)))


def passing(h: np.ndarray, picks: tuple[int, np.ndarray]) -> np.ndarray:
    """Which of the hashes pass the filter."""
    bits, words = picks
    keep = np.ones(len(h), bool)
    for at in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
        keep &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return keep


def star_step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b), a < b: the same components, closer to stars."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = (edges.join(low, edges.a == low.u).select(F.col("b").alias("x"), F.col("m").alias("y"))
             .unionByName(low.filter("u <> m").select(F.col("u").alias("x"), F.col("m").alias("y")))
             .filter("x <> y").distinct())
    down = large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    base = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    small = (down.join(base, down.u == base.w).filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
             .unionByName(base.select(F.col("m").alias("a"), F.col("w").alias("b"))))
    return small.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that links reach.

    Repeated large-star and small-star steps, each written to the shared folder, until a step changes nothing; nothing is
    collected but one count and checksum a step. Links may repeat, run in both directions, or join a node with itself.
    """
    clean = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    now, seen = Stored(star_step(clean), "links"), None
    while True:
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, before = mark, now
        if not mark[0]:
            break
        now = Stored(star_step(before.df), "links")
        before.drop()
    stars = now.df
    return stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def centre_pairs(groups: DataFrame, turn: int, alike: Callable[[str, str], Column],
                 able: Callable[[Column, str, str], Column] | None) -> DataFrame:
    """(a, b) once for members of a token group and a few members chosen by hash, in different components.

    A node meets the centres of its first ``FIRST`` groups in the order, so that members of one family make a few rows each and not
    one a token; a pair that its places there leave too little to share waits for the last turn, which has all of them."""
    early = F.row_number().over(Window.partitionBy("node").orderBy("pos", "token"))
    few = groups.withColumn("early", early).filter(F.col("early") <= FIRST).drop("early")
    chosen = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(turn))))
    centre = few.withColumn("chosen", chosen).filter(F.col("chosen") <= CENTRES[turn]).select(
        "token", F.struct("node", "n", "pos", "root").alias("c"))
    low = F.col("node") < F.col("c.node")

    def side(name: str, first: bool) -> Column:
        return F.when(low if first else ~low, F.col(name)).otherwise(F.col(f"c.{name}"))

    pairs = (few.join(centre, "token").filter(F.col("root") != F.col("c.root"))
             .select(side("node", True).alias("a"), side("node", False).alias("b"), side("n", True).alias("na"), side("n", False).alias("nb"),
                     side("pos", True).alias("i"), side("pos", False).alias("j")).filter(alike("na", "nb"))
             .groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.min("i").alias("i"), F.min("j").alias("j")))
    if able is not None:
        pairs = pairs.filter(able(F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")), "na", "nb"))
    return pairs.select("a", "b")


def open_pairs(groups: DataFrame, alike: Callable[[str, str], Column]) -> DataFrame:
    """(a, b, na, nb, i, j, c) once for all pairs of a token group in different components; i and j are the first places shared,
    c counts the shared tokens."""
    one = groups.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("i"), "root")
    other = groups.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("j"), F.col("root").alias("s"))
    return (one.join(other, "token")
            .filter((F.col("a") < F.col("b")) & (F.col("root") != F.col("s")) & alike("na", "nb"))
            .groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.min("i").alias("i"), F.min("j").alias("j"), F.count("*").alias("c")))


def possible(pairs: DataFrame, elsewhere: DataFrame, able: Callable[[Column, str, str], Column] | None,
             rest: Callable[[str], Column] | None) -> DataFrame:
    """Pairs whose overlap may still suffice.

    Nothing is shared before the first shared place, and of the prefix that ends first in the order only c tokens are shared, so
    besides them at most the ``rest`` outside it. Both bounds grow by the tokens of both nodes that these groups leave out,
    ``elsewhere`` (node, o).
    """
    if able is None:
        return pairs.select("a", "b")
    x, y = (elsewhere.select(F.col("node").alias(n), F.col("o").alias(o)) for n, o in (("a", "oa"), ("b", "ob")))
    more = F.least(F.coalesce("oa", F.lit(0)), F.coalesce("ob", F.lit(0)))
    most = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j"), F.greatest(rest("na"), rest("nb")) + F.col("c")) + more
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(able(most, "na", "nb")).select("a", "b")


def last_pairs(groups: DataFrame, elsewhere: DataFrame, alike: Callable[[str, str], Column],
               able: Callable[[Column, str, str], Column] | None, rest: Callable[[str], Column] | None) -> DataFrame:
    """(a, b) once for all pairs of large token groups in different components whose overlap may still suffice, as ``possible`` finds
    them among ``open_pairs``.

    Members of one family share most tokens of their prefixes. So each row has the first ``LISTED`` tokens of its node here, and a
    pair is made at the first of them that both have, and not at each shared token; the bounds are conditions of the join too, so
    that pairs which cannot link are never rows. Beyond the lists a pair may be made several times and tokens count as shared."""
    own = (groups.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("at"))
           .select("node", F.slice(F.col("at.token"), 1, LISTED).alias("here"), F.greatest(F.size("at") - LISTED, F.lit(0)).alias("beyond")))
    rows = groups.join(own, "node").join(elsewhere, "node", "left").withColumn("o", F.coalesce("o", F.lit(0)))
    one, other = (rows.select("token", *[F.col(c).alias(f"{c}_{end}") for c in ("node", "n", "pos", "root", "here", "beyond", "o")]) for end in "ab")
    both = F.array_intersect("here_a", "here_b")
    keep = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & alike("n_a", "n_b")
    if able is not None:
        more = F.least("o_a", "o_b")
        keep &= able(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) + more, "n_a", "n_b")
        keep &= able(F.greatest(rest("n_a"), rest("n_b")) + F.size(both) + F.col("beyond_a") + F.col("beyond_b") + more, "n_a", "n_b")
    keep &= (F.size(both) == 0) | (F.get(both, F.lit(0)) == F.col("token"))
    return one.join(other.withColumnRenamed("token", "other"), (F.col("token") == F.col("other")) & keep).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def linked_components(shared: DataFrame, verifier: Callable[[DataFrame, bool], Callable[[DataFrame], Stored]],
                      alike: Callable[[str, str], Column] = lambda one, other: F.lit(True),
                      able: Callable[[Column, str, str], Column] | None = None, rest: Callable[[str], Column] | None = None) -> DataFrame:
    """(node, root) of the components that verified pairs make among nodes that share a token.

    ``shared`` is a stored (token, node, n, pos, m): a node with n tokens has the token at place pos, and m nodes share it.
    ``alike`` is a cheap condition on two n, ``able`` one on the largest possible overlap of two nodes, ``rest`` the number of
    tokens outside the prefix. ``verifier`` gets nodes that may be compared, and whether it is called more than once, and returns what
    keeps of pairs (a, b) those that link. Groups up to ``SMALL`` members
    give all their pairs. A larger one is first compared with 1, then 8, then 32 centres and contracted to components each time; then all
    pairs that are still in different components are compared. So the components are those of all links, while a large
    group of linked members never gives all its pairs.
    """
    with Scope() as scope:
        roots = Stored(_linked(shared, verifier, alike, able, rest), "components")
        scope.keep(roots)
    return roots.df


def _linked(shared: DataFrame, verifier, alike, able, rest) -> DataFrame:
    shared = shared.withColumn("root", F.col("node"))
    large = shared.filter(F.col("m") > SMALL)
    held = Stored(large.groupBy("node").agg(F.count("*").alias("o")), "large")
    first = possible(open_pairs(shared.filter(F.col("m") <= SMALL), alike), held.df, able, rest)
    pairs = Stored(first.unionByName(centre_pairs(large, 0, alike, able)).distinct(), "pairs")
    ends = pairs.df.select(F.col("a").alias("node")).unionByName(pairs.df.select(F.col("b").alias("node")))
    verified = verifier(ends.distinct(), False)
    found = tested = None
    turn, last = 0, False
    while True:
        turn += 1
        links = verified(pairs.df)
        found = links.df if found is None else found.unionByName(links.df)
        tested = pairs.df if tested is None else tested.unionByName(pairs.df)
        roots = Stored(components(found), "roots").df
        if last or not held.df.limit(1).count():
            return roots
        groups = (shared.filter(F.col("m") > SMALL).drop("root").join(roots, "node", "left")
                  .withColumn("root", F.coalesce("root", "node")))
        split = Stored(groups.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(
            F.sum("c").alias("c"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("left")).filter("left > 0"), "split")
        members, left = split.df.agg(F.sum("c"), F.sum("left")).first()
        if not members:
            return roots
        if turn == 1:
            verified = verifier(held.df.select("node"), True)
        open_ = groups.join(split.df.select("token"), "token", "left_semi")
        last = turn == len(CENTRES) or left <= SMALL * members
        if last:
            here = open_.groupBy("node").agg(F.count("*").alias("h"))
            every = shared.groupBy("node").agg(F.count("*").alias("q"))
            elsewhere = here.join(every, "node").select("node", (F.col("q") - F.col("h")).alias("o"))
            step = last_pairs(open_, elsewhere, alike, able, rest)
        else:
            step = centre_pairs(open_, turn, alike, able)
        pairs = Stored(step.join(tested, ["a", "b"], "left_anti"), "pairs")
