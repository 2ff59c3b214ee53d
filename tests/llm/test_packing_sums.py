"""Exact complements of three lengths."""

import random
import time
from collections import Counter

import pytest

from choicefield.llm import packing


@pytest.mark.parametrize("counts, sequences", [
    ({520: 700, 200: 700, 172: 700, 132: 700}, 700), ({512: 1, 256: 2}, 1), ({256: 8}, 2), ({512: 3, 300: 1, 212: 1}, 2),
    ({400: 5, 208: 15}, 5), ({1000: 3, 8: 9}, 3), ({}, 0)])
def test_three_lengths_fill_a_gap(counts, sequences):
    assert packing.plan(counts)[1] == sequences


def test_exact_steps_leave_no_combination():
    """What is left holds no two, three or four pieces that fill a sequence, and nothing is used that was not there."""
    rng = random.Random(3)
    for _ in range(150):
        counts = Counter({rng.randint(1, 39): rng.randint(1, 4) for _ in range(rng.randint(1, 9))})
        left = Counter(counts)
        used = Counter()
        for lengths, times in packing.exact_steps(left, 40):
            assert times > 0 and sum(lengths) == 40
            used.update({x: k * times for x, k in Counter(lengths).items()})
        assert all(left[x] >= 0 and left[x] + used[x] == counts[x] for x in counts)
        reach = {(0, 0)}
        for x in left.elements():
            reach |= {(n + 1, s + x) for n, s in reach if n < 4 and s + x <= 40}
        assert not {(2, 40), (3, 40), (4, 40)} & reach


def test_all_lengths_are_planned_fast():
    rng = random.Random(4)
    counts = {x: rng.randint(1, 10 ** 6) for x in range(1, 1024)}
    began = time.time()
    rows, sequences = packing.plan(counts)
    assert sequences >= sum(x * c for x, c in counts.items()) / 1024 and time.time() - began < 60
