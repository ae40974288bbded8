"""What several pieces ask of a shard is looked up once, and each gets the codes of its own question."""

import numpy as np

from reportloom.llm import language_model as lm
from reportloom.llm.elias_fano import Trie, unpack


def test_a_triple_is_looked_up_once(monkeypatch):
    sought = []
    triple = Trie.triple
    monkeypatch.setattr(Trie, "triple", lambda self, pair, w: sought.append(len(w)) or triple(self, pair, w))
    prints = np.array([0, 1, 2, 70, 80, 90], np.uint32)
    u, v, w = np.array([1, 3, 3, 4]), np.array([3, 4, 4, 5]), np.array([4, 2, 5, 0])
    ask = lambda n: lm._question(prints, u, v, w, np.array(n))
    part = lm._question(prints, u[2:], v[2:], w[2:], np.array([0, 0]))
    rows = [(0, lm.GRAMS, 5, ask([1, 2, 1, 1])), (1, lm.GRAMS, 5, ask([1, 0, 0, 0])), (2, lm.GRAMS, 5, part)]
    given = [r for b in lm._answer_grams({}, False)(iter([lm._batch(rows)])) for r in b.to_pylist()]
    assert [r["batch"] for r in given] == [0, 1, 2] and sought == [4]
    first, second, third = ([x.tolist() for x in unpack(r["data"])] for r in given)
    assert first == second and [len(x) for x in first] == [3, 3, 4]
    assert third == [x[-2:] for x in first]
