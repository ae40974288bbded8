import hashlib
import math
import random

import numpy as np
import pytest

from reportloom.llm import vector_codes
from reportloom.llm.vector_codes import CoverTree, compress_vectors, squared_distances


def plain(rows, entries, rounds):
    """(vec_id, label, code, error) of each row and the digest, every part compared with every entry."""
    kept = [(i, lab, [math.floor(1024 * e) for e in v]) for i, v, lab in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    n = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == n]
    cuts = [k * n // 4 for k in range(5)]
    x = np.array([r[2] for r in kept], object)
    books = [[list(r) for r in x[:entries, lo:hi]] for lo, hi in zip(cuts, cuts[1:])]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            of = [nearest(r[lo:hi], books[k])[1] for r in x]
            for e in set(of):
                own = [r[lo:hi] for r, o in zip(x, of) if o == e]
                books[k][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    done = []
    for (i, lab, _), r in zip(kept, x):
        found = [nearest(r[lo:hi], books[k]) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
        done.append((i, lab, bytes(f[1] for f in found).hex(), sum(f[0] for f in found)))
    return done, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("length", [8, 10, 1])
def test_against_every_entry(spark, length):
    rng = random.Random(length)
    centres = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(12)]
    rows = [(k, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([None, "a", "b"])) for k in range(400)]
    rows += [(1000 + k, list(centres[0]), "hot") for k in range(300)]  # one vector, very often
    rows += [(3, list(centres[1]), "a"), (3, list(centres[1]), "a"), (None, list(centres[2]), None), (5000, None, "a"), (5001, [None] * length, "a"), (5002, [float("nan")] * length, None), (5003, [float("inf")] * length, None), (5004, [], "a"), (5005, [0.5] * (length + 1), "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label string, error int").repartition(3)
    got = compress_vectors(df, entries=16, rounds=3).collect()
    want, digest = plain(rows, 16, 3)
    sums = {lab: sum(w[3] for w in want if w[1] == lab) for _, lab, _, _ in want}
    key = lambda r: tuple(str(c) for c in r)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=key) == sorted([(i, c, e, sums[lab]) for i, lab, c, e in want], key=key)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_empty_and_too_large(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert compress_vectors(spark.createDataFrame([], schema)).collect() == []
    assert compress_vectors(spark.createDataFrame([(1, None, 2)], schema)).collect() == []
    one = compress_vectors(spark.createDataFrame([(1, [0.25] * 4, None)], schema)).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00000000", 0, 0)]
    with pytest.raises(Exception, match="too large"):
        compress_vectors(spark.createDataFrame([(1, [1e30] * 4, None), (2, [-1e30] * 4, None)], schema)).collect()


def test_cover_tree_invariants_and_whole_subtrees():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(c, 40, (150, 6)) for c in (0, 4000, 9000)]).astype(np.int64)
    rows = np.concatenate([rows, rows[:50]])
    tree = CoverTree.load(CoverTree.build(rows).dump())
    assert (tree.points[tree.place] == rows).all() and tree.counts.sum() == len(rows)
    for k in range(len(tree.radius)):
        inside = tree.points[tree.start[k] : tree.end[k]]
        far = squared_distances(tree.points[[tree.centre[k]]], inside)
        assert np.isclose(math.sqrt(far.max()), tree.radius[k])
        below = tree.children[tree.first[k] : tree.first[k + 1]]
        assert not len(below) or sorted(i for c in below for i in range(tree.start[c], tree.end[c])) == list(range(tree.start[k], tree.end[k]))
    book = rng.normal(0, 1, (3, 6)).astype(np.int64) + np.array([[0], [4000], [9000]])
    ranges = [(s, e, x) for starts, ends, xs in tree.assign(book) for s, e, x in zip(starts, ends, xs)]
    assert len(ranges) < 10  # three far groups are given away whole
    for s, e, x in ranges:
        assert (squared_distances(tree.points[s:e], book).argmin(1) == x).all()
    big = np.array([[1 << 28, 0], [-(1 << 28), 3]])
    assert squared_distances(big, big).tolist() == [[0, (1 << 58) + 9], [(1 << 58) + 9, 0]]


def test_ranges_hold_for_entries_at_equal_distances():
    tree = CoverTree.build(np.array([[0, 0], [2, 0], [4, 0], [4, 0]]))
    own = {}
    for starts, ends, xs in tree.assign(np.array([[3, 0], [1, 0], [1, 0], [3, 0]])):
        for s, e, x in zip(starts, ends, xs):
            own |= {tuple(p): int(x) for p in tree.points[s:e]}
    assert own == {(0, 0): 1, (2, 0): 0, (4, 0): 0}
    assert vector_codes.PARTS == 4
