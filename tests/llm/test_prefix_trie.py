import collections
import hashlib
import random
import zlib

import pytest

from reportloom.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def plain(rows):
    """The contract's rows by walking every beginning of every rebuilt conversation."""
    own = collections.defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
    for c, at, role, text, *_ in rows:
        if c is not None:
            own[c].append((at is not None, at or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = 0 if c % 5 == 0 else zlib.crc32(str(c).encode()) % 9
        full[c] = tuple((own.get(c - c % 5, [])[:h] if h else []) + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    below = collections.defaultdict(list)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    out, total = [], {}
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        saved = (n - 1) * (len(path[-1][1].encode()) if path else 0) + sum(total[b][0] for b in below[path])
        leaves = sum(total[b][1] for b in below[path]) or 1
        total[path] = saved, leaves
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if len(full[c]) == len(path)))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, n, len(below[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tables():
    rng = random.Random(3)
    role = lambda k: ["user", "assistant", None, ""][k % 4]
    rows = []
    for c in range(40):  # few words, so that beginnings are shared
        rows += [(c, t if t else None, role(t), rng.choice(["a", "b", "é"]) * rng.randint(0, 2), 9) for t in range(rng.randint(1, 12))]
    long = [(t, "user", f"turn {t % 7} " + "x" * (t % 5), 9) for t in range(20)]
    for c in range(100, 220, 5):  # copies of one long conversation, and some that leave it late
        rows += [(c, *t) for t in long[: 20 if c < 190 else 16]] + ([(c, 99, "user", f"end {c}", 9)] if c % 3 == 0 else [])
    rows += [(7, None, None, None, 9), (7, None, None, None, 9), (7, 3, "user", "a", 9), (None, 1, "user", "a", 9), (None, None, None, None, None)]
    rows += [(301, 0, "user", "only", 9), (1000, 1, "user", "very long " * 20_000, 9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,stretch,chunk", [(8, 1 << 15, 1 << 13), (3, 2, 2)])
def test_against_every_beginning(spark, monkeypatch, width, stretch, chunk):
    monkeypatch.setattr(trie, "STRETCH", stretch)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = tables()
    got = sorted([tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), width).collect()], key=str)
    assert got == plain(rows)


def test_small_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1)], SCHEMA)).collect() == []
    # A conversation that begins with turns of one that is absent, and has none of its own beyond them, is turnless.
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    one = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame([(c, 1, "user", "x", 0)], SCHEMA)).collect()]
    assert one == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_one_conversation_is_numbered_over_many_partitions(spark):
    rows = [(5, t, "user", f"t{t}", 0) for t in range(3000)] + [(6, 1, "user", "z", 0)]
    placed, runs = trie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert runs.where("conv = 5").count() > 1
    numbers = sorted(r.n for r in placed.join(runs, ["conv", "part"]).where("conv = 5").selectExpr("before + place as n").collect())
    assert numbers == list(range(1, 3001))
