import random

import numpy as np

from reportloom.llm import embedding_dedup
from reportloom.llm.hnsw import Graph


def test_audits_take_under_a_hundredth_of_the_queries():
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 32)))
    vectors, queries = unit(2000), unit(50_000)
    shard = embedding_dedup.Shard(np.arange(2000), np.ones(2000, np.int64), vectors, Graph(vectors), 0)
    found = 0
    for lo, hi in [(0, 8192), (8192, 10_000), (10_000, 18_192), (18_192, 20_000), *[(k, k + 6000) for k in range(20_000, 50_000, 6000)]]:
        own = np.arange(10_000 + lo, 10_000 + hi)
        found += sum(len(src) for src, *_ in shard.search(own, np.zeros(hi - lo, np.int64), np.ones(hi - lo, np.int64), queries[lo:hi]))
    assert shard.seen == 50_000 and shard.drawn < 500 and shard.width == embedding_dedup.BEAM and not found


def test_rare_links_of_many_batches_count_together():
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = unit(rng.standard_normal((1500, 24)))
    shard = embedding_dedup.Shard(np.arange(1500), np.ones(1500, np.int64), vectors, Graph(vectors), 0)
    for k in range(6):
        queries = unit(np.concatenate([rng.standard_normal((900, 24)), vectors[rng.integers(0, 1500, 100)] + 0.02 * rng.standard_normal((100, 24))]))
        list(shard.search(np.arange(9000 + 1000 * k, 10_000 + 1000 * k), np.zeros(1000, np.int64), np.ones(1000, np.int64), queries))
    assert 0 < len(shard.asked) and shard.drawn <= embedding_dedup.AUDIT


def test_recall_on_planted_vectors(spark):
    """Through the whole operator: 20,000 vectors, most of them alone, and groups of near copies of different sizes."""
    rng, pick = np.random.default_rng(3), random.Random(3)
    base = rng.standard_normal((14_000, 24))
    group, vectors = list(range(len(base))), [base]
    while len(group) < 20_000:
        g = pick.randrange(1500)
        group.append(g)
        vectors.append(base[g : g + 1] + 0.18 * rng.standard_normal((1, 24)))
    x = np.concatenate(vectors)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([((u[k : k + 1000] @ u.T) >= 0.9).sum(1) - 1 for k in range(0, len(u), 1000)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    links = np.array([got[k].n_links for k in range(len(u))])
    assert (links <= want).all() and want.sum() > 5000 and links.sum() >= 0.97 * want.sum()
