import random

import numpy as np
import pytest
import xxhash

from reportloom.llm import embedding_dedup, simhash, substring_dedup
from reportloom.llm.components import connected_components


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(80)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 1), (7, 7)], "src long, dst long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def fingerprint(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("chunk", [8192, 4])
def test_simhash_against_all_pairs(spark, chunk):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, ""), (5, None), (9, "one"), (10, "X" * 50_000 + " é ü")]
    for i in range(60):
        text = [rng.choice(words) for _ in range(120)]
        docs.append((100 + 3 * i, " ".join(text)))
        for k in (1, 2):
            near = list(text)
            near[rng.randrange(120)] = "Changed"
            docs.append((100 + 3 * i + k, " ".join(near)))
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, fp int")
    own = simhash.fingerprints(df)
    fps = {d: fingerprint(d[1]) for d in docs}
    distinct = sorted(set(fps.values()))
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 3]
    part = components(distinct, links)
    assert links
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(own.select("fp").distinct(), chunk=chunk).collect()
    assert {tuple(sorted((r.src, r.dst))) for r in found} <= {tuple(sorted((signed(a), signed(b)))) for a in distinct for b in distinct if part[a] == part[b]}
    rows = simhash.near_duplicates(df).collect()
    least = {}
    for (i, _), f in fps.items():
        if i is not None:
            least[part[f]] = min(least.get(part[f], i), i)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == sorted((str(d[0]), f"{fps[d]:016x}", least[part[fps[d]]]) for d in docs)
    kept = simhash.keep_one(df)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values())) and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_runs_and_planes():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    fps = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(300)]))
    want = components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3])
    at = {int(f): i for i, f in enumerate(fps)}
    got = components(range(len(fps)), [(at[int(a)], at[int(b)]) for x, y in simhash._links_of_run(fps) for a, b in zip(x, y, strict=True)])
    assert got == want
    for blocks in (4, 5, 6):
        masks = simhash.plane_masks(0, blocks)
        for _ in range(50):
            x = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(x & m == 0 for m in masks)


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 16))
    v[100:160] = v[100] + 0.12 * rng.standard_normal((60, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, v[3].tolist()), (1004, (2 * v[3]).tolist()), (1005, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, embedding array<double>, key string")
    got = embedding_dedup.near_vectors(df).collect()
    good = [(i, np.array(x) / np.linalg.norm(x)) for i, x in rows if x and len(x) == 16 and np.isfinite(x).all() and any(x)]
    m = np.array([x for _, x in good])
    links = np.argwhere(np.triu(m @ m.T >= 0.9, 1))
    part = components(range(len(good)), map(tuple, links))
    degree = np.bincount(links.ravel(), minlength=len(good))
    least = {}
    for k, (i, _) in enumerate(good):
        least[part[k]] = min(least.get(part[k], i), i)
    want = [(i, int(degree[k]), least[part[k]], i == least[part[k]]) for k, (i, _) in enumerate(good)] + [(i, 0, i, True) for i in (1000, 1001, 1002, 1003, 1005)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def planted_vectors(n, dim, seed):
    """Random vectors, a third of them in near copies: many small groups and one of a tenth."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    at = 0
    for size in [n // 10, *rng.integers(2, 7, n // 15).tolist()]:
        v[at : at + size] = v[at] + rng.uniform(0.02, 0.3) * rng.standard_normal((size, dim))
        at += size
    return rng.permutation(v / np.linalg.norm(v, axis=1, keepdims=True))


def test_graph_search_at_size():
    """A shard of 12,000 rows: beams stay far below its size and 0.99 of the links are found, all of crowded queries."""
    v = planted_vectors(24_000, 48, 3)
    nodes = np.arange(0, len(v), 2)
    shard = embedding_dedup.Shard(nodes, np.ones(len(nodes), np.int64), v[nodes], embedding_dedup.Graph(v[nodes]), 0)
    pairs, number = set(), {}
    for lo in range(0, len(v), 4096):
        own = np.arange(lo, min(len(v), lo + 4096))
        for src, dst, _, kind, n in shard.search(own, own % 2, np.ones(len(own), np.int64), v[own]):
            if kind == embedding_dedup.PAIR:
                pairs |= set(zip(src.tolist(), dst.tolist(), strict=True))
            elif kind == embedding_dedup.COUNT:
                number |= dict(zip(src.tolist(), n.tolist(), strict=True))
    true = v @ v[nodes].T >= 0.9
    true[nodes, np.arange(len(nodes))] = False
    degree = true.sum(1)
    few = [(int(a), int(nodes[b])) for a, b in np.argwhere(true) if degree[a] <= embedding_dedup.FEW]
    assert shard.width <= 64 and len(few) > 10_000 and np.mean([p in pairs for p in few]) >= 0.99
    assert {a: int(degree[a]) for a in np.nonzero(degree > embedding_dedup.FEW)[0]} == number and len(number) > 2_000


def test_audit_without_links_keeps_the_beam():
    v = np.random.default_rng(9).standard_normal((2_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    shard = embedding_dedup.Shard(np.arange(1_000), np.ones(1_000, np.int64), v[:1_000], embedding_dedup.Graph(v[:1_000]), 0)
    own = np.arange(2_000)
    assert not list(shard.search(own, own // 1_000, np.ones(2_000, np.int64), v)) and shard.width == embedding_dedup.BEAM


def test_compact_windows_cover_every_window_once():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 40, 120).astype(np.uint64)
    for length in (1, 7):
        found = substring_dedup.compact_windows(h, length)
        for s in range(len(h) - length + 1):
            e = s + length - 1
            at = [i for a, i, b in found if a <= s <= i <= e <= b]
            assert len(at) == 1 and h[at[0]] == h[s : e + 1].min()


def test_passages_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 5000)}"
    shared = [[word() for _ in range(n)] for n in (50, 55, 90, 40)]
    docs = [(i, [word() for _ in range(rng.randint(0, 150))]) for i in range(60)]
    for i in range(0, 40):
        at = rng.randint(0, len(docs[i][1]))
        docs[i][1][at:at] = shared[i % 4]
    near = list(shared[2])
    near[45] = "other"
    docs += [(200, near), (201, [word() for _ in range(3)])]
    df = spark.createDataFrame([(i, " ".join(w), 1) for i, w in docs] + [(None, " ".join(shared[0]), 1), (300, None, 1), (301, "", 1)], "doc_id long, text string, key int")
    by = {}
    for i, w in docs:
        for k in range(len(w) - 49):
            by.setdefault(tuple(w[k : k + 50]), set()).add(i)
    truth = {i for s in by.values() if len(s) > 1 for i in s}
    rows = substring_dedup.repeated_passages(df).collect()
    words = dict(docs)
    found = {r.doc_id for r in rows} | {r.other_id for r in rows}
    assert truth <= found and found <= truth | {200} and {i for i in range(40) if i % 4 < 3} <= found and not {i for i in range(40, 60)} & found
    for r in rows:
        if r.similarity == 1:
            assert words[r.doc_id][r.start : r.end] == words[r.other_id][r.other_start : r.other_end] and r.end - r.start >= 50
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0
    equal = substring_dedup.repeated_passages(spark.createDataFrame([(5, " a" * 60), (4, " a" * 60), (4, " a" * 60), (3, "b"), (2, "b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in equal] == [(5, 4, 0, 60, 0, 60, 1.0)]


def best_similarity(a, b, length=46):
    """Of all pairs of windows."""
    wa, wb = ([frozenset(h[i : i + length].tolist()) for i in range(len(h) - length + 1)] for h in (a, b))
    return max((len(x & y) / len(x | y) for x in wa for y in wb if len(x & y) > 36), default=0.0)


@pytest.mark.parametrize("words,changed,inserted,removed", [(50, 1, 0, 0), (60, 2, 0, 0), (60, 0, 1, 0), (80, 0, 2, 0), (60, 0, 0, 1), (120, 4, 0, 0)])
def test_near_passages_are_found(spark, words, changed, inserted, removed):
    """At least 0.9 of the planted near copies that have a window of 50 words at a similarity of 0.8."""
    rng = random.Random(words * 100 + changed * 10 + inserted)
    word = lambda: f"w{rng.randint(0, 50_000)}"
    some = lambda n: [word() for _ in range(n)]
    docs, qualify = [], []
    for k in range(60):
        passage = some(words)
        near = list(passage)
        for _ in range(changed):
            near[rng.randrange(len(near))] = word()
        for _ in range(inserted):
            near.insert(rng.randrange(1, len(near)), word())
        for _ in range(removed):
            del near[rng.randrange(len(near))]
        pair = [" ".join(some(rng.randint(0, 90)) + x + some(rng.randint(0, 90))) for x in (passage, near)]
        docs += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        if best_similarity(*(substring_dedup.shingle_hashes(substring_dedup.word_hashes(t)) for t in pair)) >= 0.8:
            qualify.append(k)
    found = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(qualify) > 20 and sum((2 * k + 1, 2 * k) in found for k in qualify) >= 0.9 * len(qualify)
    assert all(a == b + 1 and b % 2 == 0 for a, b in found)


def test_rare_pairs_around_a_common_line(spark, monkeypatch):
    """Each pair shares 52 words around a line that hundreds of documents have."""
    rng = random.Random(12)
    some = lambda n: [f"w{rng.randint(0, 50_000)}" for _ in range(n)]
    line, docs = some(40), []
    for k in range(300):
        docs.append((k, " ".join(some(60) + line + some(60))))
    for k in range(40):
        passage = (lambda a: some(0) + a[0] + line + a[1])((some(6), some(6)))
        docs += [(1000 + 2 * k + i, " ".join(some(40) + passage + some(40))) for i in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for held in (1 << 20, 500):
        monkeypatch.setattr(substring_dedup, "HELD", held)
        found = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(df).collect()}
        assert found == {(1001 + 2 * k, 1000 + 2 * k) for k in range(40)}
