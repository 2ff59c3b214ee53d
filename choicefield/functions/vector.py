"""Normal law and Halton points on numpy arrays, for kernels inside tasks; the Column forms are in ``normal`` and ``kernels``."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .normal import AS241_CENTRE, AS241_MIDDLE, AS241_TAIL, HART_DEN, HART_NUM, HART_SPLIT, SQRT_2PI

TABLE = 4096  # mirrored numbers in one table


def norm_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / SQRT_2PI


def horner(coefs, x: np.ndarray) -> np.ndarray:
    """``np.polyval`` without an array for every step."""
    out = np.full_like(x, coefs[0])
    for c in coefs[1:]:
        out *= x
        out += c
    return out


def tail_and_exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phi(-|x|) and exp(-x^2 / 2), which it needs; |x| counts as 38 at most."""
    a = np.abs(x)
    np.minimum(a, 38.0, out=a)
    e = np.exp(-0.5 * a * a)
    tail = e * horner(HART_NUM, a) / horner(HART_DEN, a)
    far = ~(a < HART_SPLIT)
    if far.any():
        a = a[far]
        frac = a + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            frac = a + k / frac
        tail[far] = e[far] / frac / SQRT_2PI
    return tail, e


def norm_cdf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    tail = tail_and_exp(x)[0]
    return np.where(x > 0, 1 - tail, tail)


def interval_prob(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Phi(high) - Phi(low), taken in the tail where both are small."""
    flip = low > 0
    return norm_cdf(np.where(flip, -low, high)) - norm_cdf(np.where(flip, -high, low))


def interval_of_tails(low: np.ndarray, low_tail: np.ndarray, high: np.ndarray, high_tail: np.ndarray) -> np.ndarray:
    """``interval_prob`` from the tails of its ends."""
    return np.where(low > 0, low_tail - high_tail, np.where(high > 0, 1 - high_tail, high_tail) - low_tail)


def norm_ppf(p: np.ndarray) -> np.ndarray:
    q = p - 0.5
    c = 0.180625 - q * q
    out = q * horner(AS241_CENTRE[0], c) / horner(AS241_CENTRE[1], c)
    outer = ~(np.abs(q) <= 0.425)
    if outer.any():
        p, q = p[outer], q[outer]
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        middle = horner(AS241_MIDDLE[0], r - 1.6) / horner(AS241_MIDDLE[1], r - 1.6)
        tail = horner(AS241_TAIL[0], r - 5) / horner(AS241_TAIL[1], r - 5)
        out[outer] = np.sign(q) * np.where(r <= 5, middle, tail)
    return out


def digits_for(largest: int, base: int) -> int:
    """Digits of the largest index in ``base``."""
    n = 1
    while base ** n <= largest:
        n += 1
    return n


def digit_maps(base: int, digits: int, seed: int | None) -> list[tuple[int, int]]:
    """(a, c) per position: digit d becomes (a d + c) mod base, a permutation as the base is prime. Without a seed nothing moves."""
    if seed is None:
        return [(1, 0)] * digits
    rng = np.random.Generator(np.random.PCG64([seed, base]))
    return [(int(rng.integers(1, base)), int(rng.integers(0, base))) for _ in range(digits)]


@lru_cache(64)
def mirrored(base: int, digits: int, seed: int | None) -> list[np.ndarray]:
    """What each number of the lowest digits adds to a radical inverse, then the next digits; as many as ``TABLE`` numbers have."""
    maps, tables, j = digit_maps(base, digits, seed), [], 0
    while j < digits:
        some = maps[j:j + max(1, digits_for(TABLE, base) - 1)]
        number, table = np.arange(base ** len(some)), np.zeros(base ** len(some))
        for a, c in some:
            j += 1
            number, digit = np.divmod(number, base)
            table += (digit if seed is None else (a * digit + c) % base) * float(base) ** -j
        tables.append(table)
    return tables


def radical_inverse(index: np.ndarray, base: int, largest: int, seed: int | None = None) -> np.ndarray:
    """Digits of ``index`` (up to ``largest``) mirrored behind the point; with a seed each digit is moved by its map, and the point
    lies in the middle of its cell, so that it is never 0."""
    digits = digits_for(largest, base)
    out = np.full(index.shape, 0.0 if seed is None else 0.5 * base ** -digits)
    rest = index.astype(np.int64)
    for table in mirrored(base, digits, seed):
        rest, low = np.divmod(rest, len(table))
        out += table[low]
    return out
