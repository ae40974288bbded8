"""The classifier against a plain one: dictionaries for arrays, a loop for every product, the rules of the learner as written."""
import hashlib
import math
import random
import re
import zlib

import numpy as np

from reportloom.llm import quality as Q


def plain_features(text):
    tokens = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
    names = [t.lower() for t in tokens] + [f"{a.lower()} {b.lower()}" for a, b in zip(tokens, tokens[1:])]

    def shape(t):
        if t.isdigit():
            return "9"
        if not t.isalpha():
            return t[:3]
        head = "x" if not t[0].isupper() and not (t.isupper() and len(t) > 1) else "X" if t.isupper() and len(t) > 1 else "Xx"
        return head + "l" * (len(t) > 9)

    names += [f"s {shape(a)} {shape(b)}" for a, b in zip(tokens, tokens[1:])]
    twice = sum(a == b for a, b in zip(tokens, tokens[1:]))
    names += [f"r {k}" for k in range(9) if twice and k <= 8 * twice / len(tokens)]
    return {0} | {1 + zlib.crc32(n.encode()) % (2**Q.BITS - 1) for n in names}


def plain_scores(docs, labels):
    """Scores of all documents, learnt one row at a time."""
    texts = {}
    for i, t in docs:
        if i is not None and (i not in texts or texts[i] is None or t is not None and t < texts[i]):
            texts[i] = t
    rows = [(i, q) for i, q in labels if i in texts and q in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    rows = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r))[: Q.TRAIN_ROWS]
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    z, n = {}, {}

    def weight(f):
        s = z.get(f, 0.0)
        return 0.0 if abs(s) <= Q.L1 else (math.copysign(Q.L1, s) - s) / ((Q.BETA + math.sqrt(n.get(f, 0.0))) / Q.ALPHA + Q.L2)

    chance = lambda fs: 1 / (1 + math.exp(-sum(weight(f) for f in sorted(fs)) / math.sqrt(len(fs))))
    order = np.arange(len(rows))
    for epoch in range(Q.EPOCHS):
        np.random.default_rng(epoch).shuffle(order)
        for at in order:
            doc, label = rows[at]
            fs = plain_features(texts[doc])
            g = (chance(fs) - label) / math.sqrt(len(fs)) * (1.0 if label else Q.LOW_COST)
            for f, w in [(f, weight(f)) for f in fs]:
                old = n.get(f, 0.0)
                n[f] = old + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(old)) / Q.ALPHA * w
    return [(i, chance(plain_features(t))) for i, t in docs]


def test_scores_against_plain_learner(spark):
    rng = random.Random(21)
    words = ["river", "Bridge", "NASA", "2024", "internationally", "town", "é", "buy", "now", "!!", "..", "_"]
    text = lambda low: " ".join(rng.choice(words[6:] if low and rng.random() < 0.7 else words) for _ in range(rng.randint(1, 30)))
    docs = [(i, text(i % 3 == 0)) for i in range(150)] + [(150, None), (151, ""), (None, "river town"), (3, "zz other text of the same id"), (4, None)]
    labels = [(i, int(i % 3 != 0)) for i in range(0, 160, 2)] + [(8, 0), (None, 1), (6, None), (3, 0), (150, 0)]
    got = Q.quality_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = plain_scores(docs, labels)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [i for i, _ in found] == [i for i, _ in sorted(want, key=key)]
    assert all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(found, sorted(want, key=key), strict=True))
    assert len({round(s, 4) for _, s in want}) > 100
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
