"""N-gram Jaccard join: prefix filters under several global token orders, then exact verification.

A document is the set of its distinct word shingles. Two documents link when ``100 * |intersection| >= percent * |union|``.
Linked sets share a token among the first ``n - ceil(n * percent / 100) + 1`` tokens of either set under *every* total order
of tokens. An order here sorts by (frequency level, seeded hash): candidates come from a join on the prefix of the first
order; a pair is dropped if the places of its first shared token, or the number of shared prefix tokens, leave too little to
share, or if counts of the tokens in ``BUCKETS`` buckets do; then it is verified if its prefixes meet under all other orders too.

Scale. Equal sets are one node, so copies never meet in a join. Rare tokens come first in every order. Frequencies are counted
in two steps, as counting all tokens would shuffle more than the texts: exactly for one token in ``SAMPLED``, by hash; then, as
frequent tokens come in passages, for the tokens up to ``NEAR`` places from a frequent sampled one. The table of frequent tokens
has at most 2^20 entries whatever the input (it holds those counted more than ``rows / 2^20`` times), so it may travel with the
tasks. Every order is valid, so a token that it lacks costs time, not results. A token
group above 32 members is not expanded into all pairs: its members are first compared with a few centres, linked
sets are contracted to components, and only pairs that are still in different components are compared, until none is left.
Texts are never shuffled: a later pass over them picks its rows by a bit filter of at most 8 MB and shuffles what it makes of
them. All steps live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Scope, Stored, arrow_map, bit_filter, column, filtered, linked_components, passing, picked, text_slices
from .shingles import distinct, mix, shingle_sequences, shingle_sets

SIZE, PERCENT = 4, 85
ORDERS = 3
FREQUENT = 2
FREQUENT_TABLE = 1 << 20
SAMPLED = 16
NEAR = 64
SHARED_BLOCK = 1 << 16  # rows of one Arrow batch
BUCKETS = 256
REMEMBERED = 1 << 19  # tokens of prefixes that one task keeps
SKETCHES = "node binary, sketch binary"
_SEEDS = mix(np.arange(1, 17, dtype=np.uint64))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def order_keys(tokens: np.ndarray, order: int, levels: tuple | None) -> np.ndarray:
    """The place of each token in a global order: frequency level first, then a hash of its own."""
    key = mix(tokens ^ _SEEDS[order]) >> np.uint64(6)
    if levels is not None and len(levels[0]) and len(tokens):
        known, level = levels
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        key |= np.where(known[at] == tokens, level[at], 0).astype(np.uint64) << np.uint64(58)
    return key


def prefix(tokens: np.ndarray, order: int, percent: int, levels: tuple | None) -> np.ndarray:
    p = prefix_length(len(tokens), percent)
    if p >= len(tokens):
        return tokens[np.argsort(order_keys(tokens, order, levels))]
    keys = order_keys(tokens, order, levels)
    first = np.argpartition(keys, p - 1)[:p]
    return tokens[first[np.argsort(keys[first])]]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part in text_slices(batch):
        yield part, [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _digest(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def _node_rows(batch, size) -> Iterator[dict]:
    for part, texts in _texts(batch):
        sets = list(shingle_sets(texts, size))
        yield {"doc_id": part.column("doc_id"), "n": [len(s) for s in sets], "node": [_digest(s) for s in sets],
               "some": _lists([s[mix(s) % np.uint64(SAMPLED) == 0] for s in sets])}


def _hit_rows(batch, frequent) -> Iterator[dict]:
    """The ids of nodes with a frequent token."""
    some = batch.column("some")
    flat, at = some.values.to_numpy(zero_copy_only=False).view(np.uint64), some.offsets.to_numpy()
    hits = np.concatenate(([0], np.cumsum(_known(frequent, flat))))
    yield {"doc_id": batch.column("doc_id").filter(pa.array(hits[at[1:]] > hits[at[:-1]]))}


def _known(known: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which tokens are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def _near_rows(batch, size, frequent, wanted) -> Iterator[dict]:
    """The distinct tokens near a frequent one."""
    for _, texts in _texts(filtered(batch, wanted)):
        near = []
        for grams in shingle_sequences(texts, size):
            hits = np.flatnonzero(_known(frequent, grams))
            edge = np.zeros(len(grams) + 1, np.int64)
            np.add.at(edge, np.maximum(hits - NEAR, 0), 1)
            np.add.at(edge, np.minimum(hits + NEAR + 1, len(grams)), -1)
            near.append(distinct(grams[np.cumsum(edge[:-1]) > 0]))
        yield {"near": _lists(near)}


def _prefix_rows(batch, size, percent, levels) -> Iterator[dict]:
    for part, texts in _texts(batch):
        sets = list(shingle_sets(texts, size))
        yield {"node": [_digest(s) for s in sets], "doc_id": part.column("doc_id"), "n": [len(s) for s in sets],
               "prefix": _lists([prefix(s, 0, percent, levels) for s in sets])}


def _shared_rows(batch, picks) -> Iterator[dict]:
    """(token, node, pos, n) of the prefix tokens that pass the filter; pos is the place in the order."""
    prefixes = batch.column("prefix")
    flat, at = prefixes.values.to_numpy(zero_copy_only=False).view(np.uint64), prefixes.offsets.to_numpy()
    flat, at = flat[at[0]:at[-1]], at - at[0]
    rows = np.repeat(np.arange(len(batch)), np.diff(at))
    kept = np.flatnonzero(passing(flat, picks))
    for start in range(0, len(kept), SHARED_BLOCK):
        part = kept[start:start + SHARED_BLOCK]
        row = pa.array(rows[part])
        yield {"token": flat[part].view(np.int64), "node": batch.column("node").take(row), "pos": part - at[rows[part]], "n": batch.column("n").take(row)}


def _set_rows(batch, size, wanted) -> Iterator[dict]:
    for _, texts in _texts(filtered(batch, wanted)):
        sets = list(shingle_sets(texts, size))
        yield {"node": [_digest(s) for s in sets], "tokens": _lists(sets)}


def _sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each bucket: a byte each, or four where a count needs them."""
    counts = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def _counts(sketches: list[bytes]) -> np.ndarray:
    wide = [s if len(s) > BUCKETS else np.frombuffer(s, "u1").astype("<u4").tobytes() for s in sketches]
    return np.frombuffer(b"".join(wide), "<u4").reshape(-1, BUCKETS).astype(np.int64)


def _sketch_rows(batch, size, wanted) -> Iterator[dict]:
    for _, texts in _texts(filtered(batch, wanted)):
        sets = list(shingle_sets(texts, size))
        yield {"node": [_digest(s) for s in sets], "sketch": [_sketch(s) for s in sets]}


def _sketch_of_set_rows(batch) -> Iterator[dict]:
    yield {"node": batch.column("node"), "sketch": [_sketch(s) for s in _arrays(batch.column("tokens"))]}


def _likely_rows(batch, percent) -> Iterator[dict]:
    """The pairs that may link: two sets share at most the smaller count of every bucket."""
    for start in range(0, len(batch), 1024):
        part = batch.slice(start, 1024)
        x, y = (_counts(part.column(c).to_pylist()) for c in ("x", "y"))
        most = np.minimum(x, y).sum(axis=1)
        keep = pa.array(100 * most >= percent * (x.sum(axis=1) + y.sum(axis=1) - most))
        yield {"a": part.column("a").filter(keep), "b": part.column("b").filter(keep)}


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def _verify_rows(batch, percent, levels) -> Iterator[dict]:
    """Of the pairs whose prefixes meet under the other orders too, those that link."""
    known: dict[bytes, list[np.ndarray]] = {}
    held = 0

    def prefixes(node, tokens):
        nonlocal held
        if node not in known:
            if held > REMEMBERED:
                known.clear()
                held = 0
            known[node] = [np.sort(prefix(tokens, k, percent, levels)) for k in range(1, ORDERS)]
            held += sum(map(len, known[node]))
        return known[node]

    def shared(x, y):
        return x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y

    kept = []
    for row, (a, b, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), _arrays(batch.column("x")), _arrays(batch.column("y")))):
        if all(shared(p, q).any() for p, q in zip(prefixes(a, x), prefixes(b, y))):
            both = int(shared(x, y).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                kept.append(row)
    out = batch.take(pa.array(kept, pa.int64()))
    yield {"a": out.column("a"), "b": out.column("b")}


class Join:
    """The steps of one join over (doc_id, text)."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs.withColumn("filter_hash", F.xxhash64("doc_id")), size, percent
        self.levels = None

    def made(self, wanted: DataFrame, rows, schema: str) -> DataFrame:
        """What ``rows`` makes of the texts of the wanted (node, doc_id): one row for each node, of two columns."""
        made = arrow_map(self.docs, rows, schema, self.size, bit_filter(wanted, "doc_id"))
        return made.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(*[F.first(c).alias(c) for c in made.columns[1:]])

    def sets(self, wanted: DataFrame) -> DataFrame:
        return self.made(wanted, _set_rows, "node binary, tokens array<bigint>")

    def frequent(self, tokens: DataFrame, share: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(sorted tokens, counts) of those that occur most, at most ``FREQUENT_TABLE`` of all, of which these are one in ``share``."""
        counted = Stored(tokens.groupBy("token").count().filter(F.col("count") > FREQUENT), "frequent")
        total = counted.df.agg(F.sum("count")).first()[0] or 0
        table = counted.df.filter(F.col("count") > share * total // FREQUENT_TABLE).toArrow()
        counted.drop()
        found = table["token"].to_numpy().view(np.uint64)
        at = np.argsort(found)
        return found[at], table["count"].to_numpy()[at]

    def find_levels(self, nodes: DataFrame) -> None:
        """Frequency levels of the tokens that many nodes share, from ``nodes`` (node, doc_id, some).

        The tokens near a frequent one are counted where they are found: a text under a repeated id may count twice, which moves
        its tokens in the order and costs no link."""
        tokens, _ = self.frequent(nodes.select(F.explode("some").alias("token")), SAMPLED)
        if not len(tokens):
            return
        hit = Stored(arrow_map(nodes.select("doc_id", "some"), _hit_rows, "doc_id bigint", tokens), "hit")
        near = arrow_map(self.docs, _near_rows, "near array<bigint>", self.size, tokens, bit_filter(hit.df, "doc_id"))
        tokens, counts = self.frequent(near.select(F.explode("near").alias("token")))
        if len(tokens):
            self.levels = tokens, np.log2(np.maximum(counts, 1)).astype(np.uint64)
        hit.drop()

    def shared(self, nodes: Stored) -> Stored:
        """(token, node, n, pos, m) of the prefix tokens that m > 1 nodes share; pos is the place in the order. A filter drops most
        of the others before anything but their count is shuffled."""
        several = Stored(nodes.df.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"), "several")
        picks = bit_filter(several.df, "token", mixed=True)
        tokens = arrow_map(nodes.df.select("node", "n", "prefix"), _shared_rows, "token bigint, node binary, pos int, n bigint", picks)
        found = Stored(tokens.join(several.df, "token"), "tokens")
        several.drop()
        return found

    def verifier(self, nodes: Stored, ends: DataFrame, again: bool) -> Callable[[DataFrame], Stored]:
        """Which pairs link. Sketches are compared first, then the sets of the pairs that these leave. ``again``: it is called several
        times, so the sets are stored."""
        wanted = Stored(nodes.df.select("node", "doc_id").join(ends, "node", "left_semi"), "wanted").df
        if again:
            every = Stored(self.sets(wanted), "sets").df
            sketches = arrow_map(every, _sketch_of_set_rows, SKETCHES)
        else:
            sketches = self.made(wanted, _sketch_rows, SKETCHES)
        sketches = Stored(sketches, "sketches").df

        def met(pairs: DataFrame, what: DataFrame, column: str) -> DataFrame:
            x, y = (what.select(F.col("node").alias(end), F.col(column).alias(name)) for end, name in (("a", "x"), ("b", "y")))
            return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")

        def verified(pairs: DataFrame) -> Stored:
            likely = Stored(arrow_map(met(pairs, sketches, "sketch"), _likely_rows, "a binary, b binary", self.percent), "likely").df
            left = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
            sets = every.join(left, "node", "left_semi") if again else self.sets(Stored(wanted.join(left, "node", "left_semi"), "left").df)
            return Stored(arrow_map(met(likely, sets, "tokens"), _verify_rows, "a binary, b binary", self.percent, self.levels), "found")

        return verified

    def links(self, nodes: Stored) -> tuple[Stored, DataFrame]:
        """(node, doc_id) of all nodes, and (node, root) of the components with more than one node; ``nodes`` are removed."""
        shared = self.shared(nodes)
        named = Stored(nodes.df.select("node", "doc_id"), "names")
        nodes.drop()

        def alike(one: str, other: str) -> Column:
            return 100 * F.least(one, other) >= self.percent * F.greatest(one, other)

        def able(overlap: Column, one: str, other: str) -> Column:
            return 100 * overlap >= self.percent * (F.col(one) + F.col(other) - overlap)

        def rest(n: str) -> Column:
            return F.ceil(self.percent * F.col(n) / 100) - 1

        roots = linked_components(shared.df, lambda ends, again: self.verifier(named, ends, again), alike, able, rest)
        shared.drop()
        return named, roots


def linked_nodes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row of (doc_id, text), and (node, low, root) of every set: its smallest doc_id and its component."""
    with Scope() as scope:
        plain, linked = _linked_nodes(docs, size, percent)
        scope.keep(plain, linked)
    return plain.df, linked.df


def _linked_nodes(docs: DataFrame, size: int, percent: int) -> tuple[Stored, Stored]:
    join = Join(docs, size, percent)
    every = Stored(arrow_map(docs, _node_rows, "doc_id bigint, n bigint, node binary, some array<bigint>", size), "shingled")
    heads = Stored(every.df.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("some").alias("some")), "heads")
    plain = Stored(every.df.select("doc_id", "n", "node"), "documents")
    every.drop()
    join.find_levels(heads.df)
    heads.drop()
    made = arrow_map(docs, _prefix_rows, "node binary, doc_id bigint, n bigint, prefix array<bigint>", size, percent, join.levels)
    nodes = Stored(made.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "nodes")
    named, roots = join.links(nodes)
    first = named.df.select("node", F.col("doc_id").alias("low"))
    return plain, Stored(first.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "linked")


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: its number of distinct shingles and the smallest doc_id that links reach.

    Words are maximal runs without ASCII white space, with A-Z lower-cased. A text of fewer than ``size`` words is one shingle.
    A null or wordless text has no shingle, links with nothing and is its own component. Rows with equal texts always link;
    repeated doc_ids give a row for each input row. A null doc_id stays null and is ignored as a component's smallest id
    unless the component has no other. An empty table gives no rows; other columns of ``df`` are not read. Candidates come
    from ``ORDERS`` token orders; nothing is dropped, and no pair of linked texts is missed.
    """
    plain, grouped = linked_nodes(picked(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint")), size, percent)
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "root").select("node", "component_id")
    return (plain.join(named, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def one_per_component(df: DataFrame, size: int, percent: int) -> DataFrame:
    """One row of ``df`` (with doc_id and text) for each component of ``jaccard_components``, and every row without words.

    The row kept has the component's smallest doc_id; a null one comes last. Of several such sets the smallest digest is taken, of
    equal sets under that id the smallest row. Ids only order the rows of a component: unlike texts stay, whatever ids they share.
    """
    keyed = df.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    _, grouped = linked_nodes(picked(keyed, doc_id="doc_id", text="text"), size, percent)
    first = F.min(F.struct(F.col("low").isNull().alias("last"), "low", "node")).alias("first")
    kept = Stored(grouped.groupBy("root").agg(first).select(F.col("first.low").alias("doc_id"), F.col("first.node").alias("node")), "kept").df
    picks = bit_filter(kept, "doc_id")
    rows = keyed.withColumn("filter_hash", F.xxhash64("doc_id"))
    schema = StructType([*rows.schema, StructField("node", BinaryType())])

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(filtered(batch, picks)):
                yield part.append_column("node", pa.array([_digest(s) if len(s) else None for s in shingle_sets(texts, size)], pa.binary()))

    def key() -> Column:
        return F.concat_ws("|", F.hex("node"), F.col("doc_id").cast("string"))  # a null id adds nothing

    one = (rows.mapInArrow(with_node, schema).filter("node is not null").groupBy(key().alias("key"))
           .agg(F.min(F.struct(*map(column, df.columns))).alias("row")).join(kept.select(key().alias("key")), "key", "left_semi").select("row.*"))
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return df.filter(wordless).unionByName(one)
