"""Byte-level BPE by tree reduction: halves are encoded on their own, and neighbours are joined at their boundary.

An encoding is exactly a token sequence of which every two neighbours, taken alone, encode to themselves: the first merge that
crossed a boundary would cross it in that pair too. So the join of two encodings need only re-encode a window around the
boundary, one more token on a side at a time, until the window's outer tokens agree with the tokens beside them; the rest
provably stays. Joining is associative, which makes encodings a monoid and the tree's shape free. Decoding concatenates bytes up
the same kind of tree.

Each match of the split pattern is encoded separately; a match that is itself a token is that token, as public encoders have it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunks import Chunks
from .common import arrow_map, hold, picked, text_slices

LEAF = 12
LONG = 64
KEPT = 300_000
NONE = 1 << 32


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class Bpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes = ranks, {i: t for t, i in ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.agree = lru_cache(1 << 16)(lambda a, b: self.merged(self.bytes[a] + self.bytes[b]) == (a, b))
        self.window = lru_cache(1 << 16)(lambda a, b: self.merged(a + b))
        self.known: dict[str, bytes] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left; for leaves and windows."""
        rank_of, at = self.ranks.get, list(range(len(data) + 1))
        pairs = [rank_of(data[i:i + 2], NONE) for i in range(len(data) - 1)]
        while pairs:
            least = min(pairs)
            if least == NONE:
                break
            i = pairs.index(least)
            del pairs[i], at[i + 1]
            if i < len(pairs):
                pairs[i] = rank_of(data[at[i]:at[i + 2]], NONE)
            if i:
                pairs[i - 1] = rank_of(data[at[i - 1]:at[i + 1]], NONE)
        return tuple([self.ranks[data[a:b]] for a, b in zip(at, at[1:])])

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbouring encodings."""
        if not left or not right:
            return left or right
        i, j, step = len(left) - 1, 1, 1
        if self.agree(left[i], right[0]):
            return left + right
        while True:
            of = self.bytes
            middle = self.window(b"".join([of[t] for t in left[i:]]), b"".join([of[t] for t in right[:j]]))
            low = i == 0 or self.agree(left[i - 1], middle[0])
            high = j == len(right) or self.agree(middle[-1], right[j])
            if low and high:
                return left[:i] + middle + right[j:]
            i, j = (i if low else max(0, i - step)), (j if high else min(len(right), j + step))
            step *= 2

    def tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF:
            return self.merged(data)
        cut = len(data) // 2
        return self.join(self.tree(data[:cut]), self.tree(data[cut:]))

    def match(self, text: str) -> bytes:
        data = text.encode()
        rank = self.ranks.get(data)
        return array("I", (rank,) if rank is not None else self.tree(data)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; matches are remembered."""
        matches = self.matches(text)
        if len(self.known) > KEPT:
            self.known.clear()
        known = self.known
        for m in [m for m in set(matches) if m not in known]:
            known[m] = self.match(m)
        out = b"".join(map(known.__getitem__, matches))
        for m in [m for m in matches if len(m) > LONG]:
            known.pop(m, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 512:
            return b"".join([self.bytes[i] for i in ids])
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


_READY: dict[tuple, tuple[Bpe, Chunks]] = {}


def ready(path: str, pattern: str) -> tuple[Bpe, Chunks]:
    """One encoder for each Python worker; equal pieces of texts are encoded once while they are remembered."""
    hold(__name__, _READY.clear)
    if (path, pattern) not in _READY:
        bpe = Bpe(ranks_of(path), pattern)
        sizes = np.zeros(max(bpe.bytes) + 1, np.int64)
        sizes[list(bpe.bytes)] = [len(t) for t in bpe.bytes.values()]
        _READY[path, pattern] = bpe, Chunks(bpe.encode, sizes)
    return _READY[path, pattern]


def _code_rows(batch: pa.RecordBatch, path: str, pattern: str, whole: bool) -> Iterator[dict]:
    bpe, chunks = ready(path, pattern)
    for part in text_slices(batch):
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for code in chunks.texts([t or "" for t in part.column("text").to_pylist()]):
            ids = np.frombuffer(code, "<u4").tolist()
            data = bpe.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha256(code).hexdigest())
            out["decoded_sha256"].append(sha256(data).hexdigest())
            if whole:
                out["ids"].append(ids)
                out["decoded"].append(data.decode())
        yield {"doc_id": part.column("doc_id")} | out


def encode_decode(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row; with ``whole`` also the ids and the text decoded from them.

    ``path`` names a rank file that every executor has; ``pattern`` splits texts before merging. Digests are of the ids as
    little-endian unsigned 32-bit integers and of the decoded bytes. Null and empty texts have no ids. Repeated rows each give a
    row; an empty table gives none; other columns are not read.
    """
    rows = picked(df, doc_id=doc_id, text=text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return arrow_map(rows, _code_rows, schema + (", ids array<bigint>, decoded string" if whole else ""), path, pattern, whole)
