"""Groups of very many fingerprints against all pairs."""

import random
import time

import numpy as np
import pytest

from factloom.llm import simhash


def components(fps, links):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    by = {}
    for f in fps:
        by.setdefault(root(f), set()).add(f)
    return sorted(map(sorted, by.values()))


@pytest.mark.parametrize("seed,pairs,bits", [(1, 8, 22), (2, 3, 12), (3, 8, 64), (4, 40, 16), (5, 2, 6)])
def test_split_groups_equal_all_pairs(monkeypatch, seed, pairs, bits):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "SET", 2)
    r = random.Random(seed)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(bits), r.randrange(min(bits, 12)))) for _ in range(250)}
    fps |= {f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in list(fps)[:60]}
    fps = sorted(fps)
    forest = simhash._Forest()
    forest.group(np.array(fps, np.uint64))
    assert all((a ^ b).bit_count() <= simhash.RADIUS for a, b in forest.links) and len(forest.links) < len(fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= simhash.RADIUS]
    assert components(fps, forest.links) == components(fps, near)


def test_a_key_of_many_takes_no_square(monkeypatch):
    """40,000 fingerprints on the 22 bits that a key leaves open: links and single ones, in seconds."""
    r = np.random.default_rng(3)
    fps = np.unique(r.integers(0, 1 << 22, 40_000, dtype=np.uint64)) << np.uint64(42)
    began = time.time()
    forest = simhash._Forest()
    forest.group(fps)
    assert time.time() - began < 60 and len(forest.links) < len(fps)
