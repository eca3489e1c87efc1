"""A large group of near copies, of which many are a little less similar than the bound: right groups, and pairs that don't grow with its square."""

import random

import numpy as np
import pytest

from brute_jaccard import one_a_group
from factloom.llm import similar


def group(n, words=150, seed=5):
    """Copies of one text with one to four words changed in place."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        yield i, " ".join(t)


def test_pairs_of_a_large_group(spark, monkeypatch):
    """Of 400 sets with some 50,000 pairs across their components a few for each set are verified."""
    rows, tried, verified = list(group(400)), [], similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, sets, least: tried.append(pairs.count()) or verified(pairs, sets, least))
    found = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == one_a_group(rows)
    assert sum(tried) < 10 * len(rows)


@pytest.mark.parametrize("n", [1, 4, 9, 61, 150, 3000])
def test_parities_bound_the_difference(n):
    """Two parities differ in no more bits than the sets in elements, and in about as many where those are few; so no pair at the bound is left out."""
    rng, bits, elements = np.random.default_rng(n), 0, 0
    for _ in range(50):
        x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        for own in {0, n // 9, n // 4, n}:
            y = np.concatenate([x[: n - own], rng.integers(0, 1 << 64, own, dtype=np.uint64)])
            a, b = similar.parities([np.sort(x), np.sort(y)])
            apart = sum(int(v).bit_count() for v in a ^ b)
            bits, elements = bits + apart, elements + 2 * own
            assert apart <= 2 * own
    assert n > 150 or bits > 0.6 * elements
    assert not similar.parities([x[:0]]).any()
