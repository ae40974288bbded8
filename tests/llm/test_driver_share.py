"""What the driver is sent, and asked to run, does not grow with tasks or shuffle partitions."""

import numpy as np
import pytest

from reportloom.llm import components, decontamination
from tests.llm.test_component_tasks import _work, many_partitions  # noqa: F401  a fixture


def test_rounds_of_few_edges_run_no_broadcast_jobs(many_partitions):  # noqa: F811
    path = many_partitions.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    rows, _, tasks = _work(many_partitions, "components of a path", lambda: components.connected_components(path).collect())
    assert {(r.node, r.component) for r in rows} == {(i, 0) for i in range(61)}
    assert tasks < 250


@pytest.mark.parametrize("texts", [6, 0])
def test_fit_sends_one_matrix(spark, monkeypatch, texts):
    for name, value in {"SLICE": 5, "RANK": 5, "OVERSAMPLE": 18}.items():  # all directions are held, five are given
        monkeypatch.setattr(decontamination, name, value, raising=False)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(23)]
    items = decontamination.Items([(k, [words[i].encode() for i in rng.permutation(23)[:9]]) for k in range(12)])
    n, idf = len(items.vocabulary), rng.uniform(1, 3, len(items.vocabulary))
    docs = [" ".join(words[i] for i in rng.integers(0, 23, 40)) for _ in range(texts)]
    sample = spark.createDataFrame([(t,) for t in docs], "text string").repartition(4)
    found, jobs, _ = _work(spark, f"fit {texts}", lambda: decontamination.fit_index(sample, items, idf))

    matrix = np.zeros((n, n))
    number = {w.decode(): k for w, k in items.vocabulary.items()}
    passages = [p for t in docs for p in decontamination._passages(np.array([number.get(w, -1) for w in t.split()]), max(items.groups))]
    for p, weight in [(np.array(w), decontamination.ITEM_WEIGHT) for w in items.words] + [(p, 1) for p in passages]:
        x = np.bincount(p, minlength=n) * idf
        x /= np.linalg.norm(x) or 1
        matrix += weight * np.outer(x, x)
    vectors = np.linalg.eigh(matrix)[1][:, -5:]
    assert n == 23 and found.shape == (23, 5)
    assert np.allclose(found @ found.T, vectors @ vectors.T, atol=1e-6)
    assert jobs <= 3 * decontamination.ROUNDS
