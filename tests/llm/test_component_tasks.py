"""Few edges are few tasks, however many shuffle partitions there are."""

import pytest

from reportloom.llm import components
from reportloom.llm.decontamination import Query, document_frequencies


@pytest.fixture
def many_partitions(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


def _work(spark, name, run):
    """(result, jobs, tasks) of what ``run`` does."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        got = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    jobs = track.getJobIdsForGroup(name)
    stages = {s for j in jobs for s in track.getJobInfo(j).stageIds}
    return got, len(jobs), sum(i.numCompletedTasks for s in stages if (i := track.getStageInfo(s)))


@pytest.mark.parametrize("edges", [1 << 17, 20])
def test_rounds_take_tasks_by_their_edges(many_partitions, monkeypatch, edges):
    monkeypatch.setattr(components, "EDGES", edges, raising=False)
    path = many_partitions.createDataFrame([(i, i + 1) for i in range(60)] + [(100 + i, 99) for i in range(1, 30)], "src long, dst long")
    rows, _, tasks = _work(many_partitions, f"components {edges}", lambda: components.connected_components(path).collect())
    assert {(r.node, r.component) for r in rows} == {(i, 0) for i in range(61)} | {(i, 99) for i in [99, *range(101, 130)]}
    assert edges == 20 or tasks < 1000


def test_word_counts_take_few_jobs(many_partitions):
    docs = many_partitions.createDataFrame([("a b",), ("b c d",), (None,)], "text string")
    query = Query([(1, "a b c e f g")])
    (counts, n), jobs, _ = _work(many_partitions, "frequencies", lambda: document_frequencies(docs, query))
    assert dict(zip(query.vocabulary, counts.tolist())) == {b"a": 1, b"b": 2, b"c": 1, b"e": 0, b"f": 0, b"g": 0} and n == 3
    assert jobs <= 4
