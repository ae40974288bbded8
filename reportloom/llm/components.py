"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import checkpointed, shuffle_partitions

SALTS = 8
#: Edges that a task is given at least: a round over few edges is no round of very many empty tasks.
EDGES = 1 << 17


def _with_minimum(edges: DataFrame, parts: int) -> DataFrame:
    """Each edge (u, v) with m, the least neighbour of u, in at most ``parts`` partitions.

    The join is salted by v, so a node with very many neighbours is dealt to ``SALTS`` tasks; the minimum is
    combined before the shuffle. The join is a merge: a broadcast, which looks cheaper once few edges are left, gathers
    its side in one more job, with a task for each shuffle partition, in every round.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    least = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.hint("merge"), ["u", "salt"]).select("u", "v", "m").coalesce(parts)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that an edge touches; component is the least node reachable.

    ``edges`` has two long columns ``src`` and ``dst``. Self-loops, repeats and either direction are allowed;
    null ends are ignored; no edges give no rows. Every round contracts the graph towards its least nodes with
    two grouped minima and is checkpointed, so that no lineage grows and lost executors cost one round at most. Its tasks
    grow in number with the edges that are left, up to the number of shuffle partitions.
    """
    most = shuffle_partitions(edges.sparkSession)
    u, v = F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    now = checkpointed(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(u, v).where("u <> v").distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not seen[0] or tuple(seen) == state:
            break
        state = tuple(seen)
        parts = min(most, -(-seen[0] // EDGES))
        now = now.coalesce(parts)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, parts).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct().coalesce(parts)
        small = _with_minimum(large, parts)
        pairs = small.select("v", "m").where("v <> m").union(small.select("u", "m"))
        now = checkpointed(pairs.toDF("u", "v").distinct().coalesce(parts))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
