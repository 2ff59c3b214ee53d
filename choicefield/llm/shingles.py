"""Word shingles as sorted arrays of 64-bit hashes, computed over whole blocks of text with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[ord("A"):ord("Z") + 1] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F],
                 np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, np.uint64))


_POW = _powers(1 << 12)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, byte offset) of every maximal run without ASCII white space, A-Z lower-cased."""
    global _POW
    raw = np.frombuffer(text, np.uint8)
    ink = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(ink.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sizes = ends - starts
    if sizes.max() > len(_POW):
        _POW = _powers(int(sizes.max()))
    at = np.cumsum(sizes) - sizes
    pos = np.arange(sizes.sum()) - np.repeat(at, sizes)
    # folded before they are added: sums of plain products agree for words of a and b that mirror each other, whatever the base
    signs = _LOWER[raw[ink]] * _POW[pos]
    signs = (signs ^ (signs >> np.uint64(32))) * _STEP[0]
    signs ^= signs >> np.uint64(29)
    return mix(np.add.reduceat(signs, at) + sizes.astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces cut at white space."""
    start = 0
    while len(text) - start > BLOCK:
        cut = start + BLOCK
        while cut < len(text) and not _SPACE[text[cut]]:
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    return mix(sum(words[i:i + n] * _STEP[i] for i in range(size)))


def shingle_sequences(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its ``size``-word shingles in order; a shorter word sequence counts as one shingle."""
    def of(words: np.ndarray, grams: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.empty(0, np.uint64)
        if len(words) < size:
            return mix((words * _STEP[:len(words)]).sum(keepdims=True) + np.uint64(len(words) * _BASE % 2**64))
        return grams

    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) < BLOCK):
            total += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            words = np.concatenate([word_hashes(p)[0] for p in _pieces(texts[i])])
            yield of(words, _windows(words, size) if len(words) >= size else words)
        else:
            words, starts = word_hashes(b"\n".join(texts[i:j]))
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            cuts = np.concatenate(([0], np.searchsorted(starts, ends)))
            grams = _windows(words, size) if len(words) >= size else words
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield of(words[a:b], grams[a:max(a, b - size + 1)])
        i = j


def distinct(grams: np.ndarray) -> np.ndarray:
    grams = np.sort(grams)
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))] if len(grams) else grams


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The same as sorted distinct hashes."""
    return map(distinct, shingle_sequences(texts, size))
