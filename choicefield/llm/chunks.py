"""Texts cut where no match of a byte-level tokenizer's pattern can reach across, so that equal pieces are encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: A space between two other non-space signs starts a match, whatever follows: the pattern's white-space matches start at the
#: first white space of a run, and all others take at most one space, in front.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")
KEPT = 1_000_000
MARKS = (",", ".")
LONG = 64
JOINED = 1 << 16


class Chunks:
    """Encodes texts piece by piece and keeps up to ``KEPT`` short pieces.

    ``encode(text)`` gives the ids of a text as little-endian unsigned 32-bit integers, ``sizes`` the bytes of each id.
    """

    def __init__(self, encode: Callable[[str], bytes], sizes: np.ndarray):
        self.encode, self.sizes, self.after_space, self.at_start = encode, sizes, {}, {}
        self.marks = {m: encode(m) for m in MARKS}

    def learn(self, pieces: list[str]) -> None:
        """Codes of pieces that follow a space; many in one call, told apart again by their bytes."""
        start = size = 0
        for i, p in enumerate(pieces):
            size += len(p) + 1
            if size > JOINED or i + 1 == len(pieces):
                block = pieces[start:i + 1]
                code = self.encode(" " + " ".join(block))
                ends = np.cumsum([len(p.encode()) + 1 for p in block])
                at = 4 * (np.searchsorted(np.cumsum(self.sizes[np.frombuffer(code, "<u4")]), ends) + 1)
                self.after_space.update(zip(block, [code[a:b] for a, b in zip([0, *at.tolist()], at.tolist())]))
                start, size = i + 1, 0

    def texts(self, texts: list[str]) -> list[bytes]:
        """The concatenated codes of each text."""
        known = self.after_space
        if len(known) > KEPT:
            known.clear()
        parts = [_SAFE.split(text) if _TWO_SPACES.search(text) else text.split(" ") for text in texts]
        firsts = [p.pop(0) for p in parts]
        fresh = [p for p in set().union(*parts) if p not in known]
        # a letter and a mark after it are always different matches
        marked = [p for p in fresh if p.endswith(MARKS) and p[-2:-1].isalpha()]
        words = {p[:-1] for p in marked if p[:-1] not in known}
        words.update(set(fresh).difference(marked))
        edge = [p for p in words if not p or p[0].isspace() or p[-1].isspace()]
        self.learn(list(words.difference(edge)))
        known.update((p, self.encode(" " + p)) for p in edge)
        known.update((p, known[p[:-1]] + self.marks[p[-1]]) for p in marked)
        start = self.at_start
        if len(start) > KEPT:
            start.clear()
        for p in firsts:
            if p not in start:
                start[p] = self.encode(p)
        codes = [b"".join([start[first], *map(known.__getitem__, rest)]) for first, rest in zip(firsts, parts)]
        for p in words.union(marked):
            if len(p) > LONG:
                del known[p]
        for p in [p for p in firsts if len(p) > LONG]:
            start.pop(p, None)
        return codes
