import collections
import math
import mmap
import random
import re
import zlib

import numpy as np
import pytest

from reportloom.llm import language_model as lm
from reportloom.llm.elias_fano import EliasFano, Trie, codes, narrow, pack, unpack, values


@pytest.mark.parametrize("bound", [5, 1000, 1 << 40])
def test_sequences(bound):
    rng = np.random.default_rng(bound)
    for n in (0, 1, 3, 700):
        x = np.sort(rng.integers(0, bound, n))
        ef = EliasFano(*unpack(pack(EliasFano.of(x, bound).arrays())))
        assert ef.get(np.arange(n)).tolist() == x.tolist()
        asked = np.unique(np.concatenate([x, rng.integers(0, bound, 300), [0, bound - 1]]))
        found = ef.find(asked)
        assert [(f >= 0 and x[f] == q) if q in set(x.tolist()) else f == -1 for q, f in zip(asked.tolist(), found.tolist())] == [True] * len(asked)
        assert n == 0 or (ef.find(x[:1], 1, n)[0] > 0) == bool((x[1:] == x[0]).any())


def test_trie_from_a_mapped_file(tmp_path):
    rng = random.Random(5)
    grams = collections.Counter((rng.randint(3, 9), rng.randint(3, 40), rng.choice([0, *range(3, 30)])) for _ in range(3000))
    grams = {k: n for k, n in grams.items() if (k[2] == 0) == (k[1] == 40)}  # nothing follows word 40 alone
    u, v, w = (np.array(c, np.uint32) for c in zip(*sorted(grams)))
    n = np.array([grams[k] for k in sorted(grams)], np.int64)
    (tmp_path / "trie").write_bytes(Trie.build(u, v, w, n, {7: 100_000}, 5.0, 2.0, 0))
    with open(tmp_path / "trie", "rb") as f:
        trie = Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    one, two = collections.Counter(), collections.Counter()
    for (a, b, _), k in grams.items():
        one[a] += k
        two[a, b] += k
    one[7] = 100_000
    asked = [(a, b, c) for a in range(2, 11) for b in range(2, 42) for c in (3, 17, 29, 77)]
    a, b, c = (np.array(x, np.uint32) for x in zip(*asked))
    pair = trie.pair(a, b)
    got = [values(g) for g in trie.lookup(pair, trie.triple(pair, c))]
    q = lambda x: float(values(codes(np.array([x])))[0])
    for k, (x, y, z) in enumerate(asked):
        t = two[x, y]
        assert [g[k] for g in got] == [q(t / (one[x] + 5)) if t else 0, q(2 / (t + 2)) if t else 1, q(grams.get((x, y, z), 0) / (t + 2)) if grams.get((x, y, z)) else 0]
    assert values(codes(np.array([1.0, 0.5, 1e-9]))).tolist() == [1.0, 0.5, 0.0]
    assert narrow(np.array([0, 255])).dtype == np.uint8


def plain(docs):
    """Rows of the contract, and the score with whole counts; the tries' parts rounded as they are."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = [(i, ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", low(t)), "</s>"]) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    one, two, three, start = (collections.Counter() for _ in range(4))
    for i, w in texts:
        if not held(i):
            one.update(w[1:])
            start["<s>"] += 1
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    total, distinct = sum(one.values()), len(one)
    q = lambda x: float(values(codes(np.array([x])))[0]) if x else 0.0
    out = []
    for i, w in texts:
        base = score = known = 0
        for j in range(1, len(w)):
            p1 = (one[w[j]] + 1) / (total + distinct + 1)
            c = one[w[j - 1]] if j > 1 else start["<s>"]
            p = q(two[w[j - 1], w[j]] / (c + lm.A2)) + lm.A2 / (c + lm.A2) * p1
            if j > 1:
                c = two[w[j - 2], w[j - 1]]
                p = q(three[w[j - 2], w[j - 1], w[j]] / (c + lm.A3)) + (q(lm.A3 / (c + lm.A3)) if c else 1.0) * p
            base, score, known = base + math.log10(p1), score + math.log10(p), known + (one[w[j]] > 0)
        out.append((i, held(i), len(w) - 1, known, total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()], key=str)


@pytest.mark.parametrize("piece,shard", [(lm.PIECE, lm.SHARD), (37, 50)])
def test_against_whole_counts(spark, piece, shard):
    rng = random.Random(6)
    words = ["the", "The", "THE", "ÄB", "äb", "x y", "z\x00", *[f"w{k}" for k in range(60)]]
    docs = [(k, rng.choice([" ", "\n", "\x0b"]).join(rng.choices(words, [20] * 3 + [1] * 64, k=rng.randint(0, 90)))) for k in range(80)]
    docs += [(500, None), (501, ""), (502, " \t\r\n "), (7, "the w1 w2"), (7, "the w1 w2"), (None, "the the"), (600, "the w1 " * 700), (601, "q" * 50_000)]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, score int").repartition(3)
    corpus = lm.Corpus(df, piece=piece, shard=shard)
    assert corpus.pieces.count() > 3 * (piece < 100)
    assert corpus.shards > 4 or shard == lm.SHARD
    assert rows(corpus.scores()) == plain(docs)
    tries = [lm.mapped(bytes(r.trie)) for r in corpus.tries().collect()]
    assert sum(t.pairs.n for t in tries) > 100


def test_empty_and_untaught(spark):
    schema = "doc_id long, text string"
    assert lm.language_model_scores(spark.createDataFrame([], schema)).collect() == []
    out = next(k for k in range(100) if lm.held_out(k))
    assert rows(lm.language_model_scores(spark.createDataFrame([(out, "a b")], schema))) == [(out, True, 3, 0, 0, 0.0, 0.0)]


def test_heavy_first_words_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 0.5)
    rng = random.Random(8)
    docs = [(k, " ".join(f"a b{rng.randint(0, 90)}" for _ in range(60))) for k in range(40)]
    corpus = lm.Corpus(spark.createDataFrame(docs, "doc_id long, text string"), shard=300)
    assert max(corpus.heavy.values()) > 3
    assert rows(corpus.scores()) == plain(docs)
