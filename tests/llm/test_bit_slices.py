import random

import numpy as np
import pytest

from reportloom.llm import simhash
from test_dedup import components


def pairs_of(fps):
    return [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3]


def near_sets(rng, n):
    fps = [rng.getrandbits(64) for _ in range(n)]
    return sorted({*fps, *(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in rng.sample(fps, n // 10))})


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 500, 5000])
def test_long_runs(n):
    fps = near_sets(random.Random(n), n)
    got = [(int(a), int(b)) for x, y in simhash._links_of_run(np.array(fps, np.uint64)) for a, b in zip(x, y)]
    assert components(fps, got) == components(fps, pairs_of(fps))


@pytest.mark.parametrize("n", [2, 64, 130, 700])
def test_short_runs(n):
    rng = random.Random(n)
    runs = [near_sets(rng, rng.randint(1, 40)) for _ in range(max(1, n // 20))]
    fps = np.array([f for r in runs for f in r], np.uint64)
    keys = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    got = {tuple(sorted((int(a), int(b)))) for x, y in simhash._links_by_shift(fps, keys, max(map(len, runs))) for a, b in zip(x, y)}
    assert got == {tuple(sorted(p)) for r in runs for p in pairs_of(r)}


def test_blocks_are_abandoned(monkeypatch):
    """On random fingerprints no block reads all planes, but for the few that hold a link."""
    read, plain = [], simhash.within_radius

    def counted(planes, radius, far):
        n = 0

        def one_by_one():
            nonlocal n
            for x in planes:
                n += 1
                yield x

        out = plain(one_by_one(), radius, far)
        read.append(n)
        return out

    monkeypatch.setattr(simhash, "within_radius", counted)
    rng = np.random.default_rng(1)
    for n in (1000, 3001):
        fps = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64))
        read.clear()
        list(simhash._links_of_run(fps))
        assert max(read) < 64 and np.mean(read) < 44
        read.clear()
        list(simhash._links_by_shift(fps, np.repeat(np.arange(n), 40)[:n], 40))
        assert max(read) < 64 and np.mean(read) < 44
