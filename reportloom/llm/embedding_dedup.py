"""Embedding near-duplicates: one layered small-world graph per shard, every vector queried in every shard.

Equal vectors are one node with a count. Nodes are dealt to shards by hash; each shard's graph is built in a task of its
own. Queries come in blocks of ``BLOCK_ROWS``; a task is one (shard, block): the graph is read once and its queries are
streamed past it in batches, so a graph travels once for a million queries and no task holds more than a shard and a batch.

Batches are audited before they are searched: some queries are compared with the whole shard, no more than one in ``SHARE``
of those seen, until ``LINKS`` links are known, and the beam is doubled until the audited queries find ``RECALL`` of
those links; then the next audit waits until twice as many queries have come. A query's link to itself does not count;
queries without links say nothing and keep the beam. Only then a batch is searched, once, at that width; a beam that is full
of links is widened for its query alone.

Links are verified in double precision. A task gives, for each query, its links if they are few (``FEW``) and else their
number, and a spanning forest, never all pairs of a cluster. A link that one end alone has found counts for both; only
numbers given in place of links can miss such. Components are joined by star contraction.

Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing and are kept. Vectors of other
lengths link only among their own length. Null ids count as vectors; they stand for no component unless all ids of it
are null. Repeated rows link with each other. Extra columns are ignored; no rows give no rows.

Calling ``near_vectors`` runs jobs (it writes checkpoints between its steps), not only the action on its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.llm.common import checkpointed
from reportloom.llm.components import connected_components
from reportloom.llm.hnsw import Graph

LEAST, RECALL = 0.9, 0.99
#: Rows and bytes of a shard on average, at most; at least ``SHARDS`` shards if they have ``SHARD_LEAST`` rows.
SHARD_ROWS, SHARD_BYTES, SHARDS, SHARD_LEAST = 1 << 18, 1 << 27, 6, 256
#: Queries of a task on average, at most, and of a batch.
BLOCK_ROWS, BATCH_ROWS = 1_000_000, 8_192
BEAM, LINKS, AUDIT, SHARE = 16, 64, 128, 128
#: A query's links in a shard are given one by one up to so many.
FEW = 32

TASK = "task long, part int, shard int, dim int, node long, n long, nodes binary, counts binary, vectors binary, graph binary"
LINK = "src long, dst long, shard int, kind int, n long"
#: Kinds of ``LINK``: a link (``shard``: that of dst), a number of links of src in a shard, an edge of a forest.
PAIR, COUNT, EDGE = 0, 1, 2


def _single(df: DataFrame, vector_col: str) -> bool:
    kind = df.schema[vector_col].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


def _keyed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, key): the vector as the bytes of its floats or doubles, null if it can link with nothing."""
    single = _single(df, vector_col)

    def of(batches):
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64) + 0  # no -0
            ends = np.cumsum(size)
            bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
            good = (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
            keys = [values[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends.tolist(), size.tolist(), good.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), pa.array(keys, pa.binary())], ["vec_id", "dim", "key"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    return rows.mapInArrow(of, "vec_id long, dim int, key binary")


def _unit(raw: bytes, dim: int, single: bool) -> np.ndarray:
    """Unit vectors in double precision."""
    v = np.frombuffer(raw, np.float32 if single else np.float64).reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _built(single: bool):
    """One graph of the rows (task, shard, dim, node, n, key) of a partition, which are a shard in random order."""

    def build(batches):
        held = pa.Table.from_batches(batches)
        if not held.num_rows:
            return
        nodes, counts = (held.column(c).to_numpy().astype(np.int64) for c in ("node", "n"))
        raw = b"".join(held.column("key").to_pylist())
        task, shard, dim = (held.column(c)[0].as_py() for c in ("task", "shard", "dim"))
        row = {"task": task, "part": 0, "shard": shard, "dim": dim, "node": None, "n": None, "nodes": nodes.tobytes(), "counts": counts.tobytes(), "vectors": raw, "graph": Graph(_unit(raw, dim, single)).dump()}
        kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 2, *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    return build


class Shard:
    """A shard's graph, searched batch by batch; ``width`` is what the audits have asked for so far."""

    def __init__(self, nodes: np.ndarray, counts: np.ndarray, vectors: np.ndarray, graph: Graph, number: int, least: float = LEAST, recall: float = RECALL):
        self.nodes, self.counts, self.vectors, self.graph, self.number = nodes, counts, vectors, graph, number
        self.least, self.low, self.recall = least, np.float32(least - 1e-4), recall
        self.width, self.root = BEAM, np.arange(len(nodes))
        self.seen = self.drawn = self.wait = 0
        self.asked, self.true = self.graph.vectors[:0], []
        by = np.argsort(nodes, kind="stable")
        self.sorted, self.by = nodes[by], by

    def _own_rows(self, own: np.ndarray) -> np.ndarray:
        """The rows of queries that lie in this shard, -1 for others."""
        at = np.minimum(np.searchsorted(self.sorted, own), len(self.sorted) - 1)
        return np.where(self.sorted[at] == own, self.by[at], -1)

    def audit(self, own: np.ndarray, q32: np.ndarray) -> None:
        """Doubles the beam until queries drawn from the batches so far find ``recall`` of their links.

        Drawn queries are compared with the whole shard: ``AUDIT`` of them at once, and in all no more than one in ``SHARE``
        of those seen. What they link with is kept, so that where links are rare the audits of many batches count together.
        Once ``LINKS`` links are known, the next audit waits until twice as many queries have been seen.
        """
        self.seen += len(own)
        room = max(AUDIT, self.seen // SHARE) - self.drawn
        if room <= 0 or self.seen < self.wait:
            return
        drawn = np.random.default_rng(self.seen).permutation(len(own))[:room]
        itself, links = self._own_rows(own), 0
        for lo in range(0, len(drawn), AUDIT):
            some = drawn[lo : lo + AUDIT]
            self.drawn += len(some)
            who, row = np.nonzero(q32[some] @ self.graph.vectors.T >= np.float32(self.least + 1e-6))
            other = itself[some[who]] != row
            who, row = some[who[other]], row[other]
            asked, at = np.unique(who, return_inverse=True)
            self.true.append((at + len(self.asked)) * len(self.nodes) + row)
            self.asked = np.concatenate([self.asked, q32[asked]])
            links += len(who)
            if links >= LINKS:
                break
        true = np.concatenate(self.true)
        while links and self.width < self.graph.dearest():
            found = [who * len(self.nodes) + row for who, row in self.graph.near_rows(self.asked, self.low, self.width)]
            if np.isin(true, np.concatenate(found)).mean() >= self.recall:
                break
            self.width *= 2
        if len(true) >= LINKS:  # the next audit draws anew
            self.wait, self.asked, self.true = 2 * self.seen, self.asked[:0], []

    def search(self, own: np.ndarray, shards: np.ndarray, copies: np.ndarray, q: np.ndarray):
        """Rows of ``LINK`` (as columns) for a batch of queries, given by node, own shard, copies and unit vector."""
        q32 = q.astype(np.float32)
        self.audit(own, q32)
        for who, row in self.graph.near_rows(q32, self.low, self.width):
            parts = range(0, len(who), 1 << 16)
            exact = np.concatenate([np.einsum("kd,kd->k", q[who[i : i + (1 << 16)]], self.vectors[row[i : i + (1 << 16)]]) for i in parts] or [np.zeros(0)])
            good = (exact >= self.least) & (own[who] != self.nodes[row])
            who, row = who[good], row[good]
            if not len(who):
                continue
            order = np.argsort(who, kind="stable")
            who, row = who[order], row[order]
            asked, first, links = np.unique(who, return_index=True, return_counts=True)
            few = np.repeat(links <= FEW, links)
            one, two = own[who[few]], self.nodes[row[few]]
            yield one, two, np.full(len(one), self.number), PAIR, self.counts[row[few]]
            yield two, one, shards[who[few]], PAIR, copies[who[few]]
            many = links > FEW
            total = np.add.reduceat(self.counts[row], first)[many]
            yield own[asked[many]], own[asked[many]], np.full(many.sum(), self.number), COUNT, total
            yield from self._forest(own[asked], row, first, links)

    def _forest(self, own: np.ndarray, row: np.ndarray, first: np.ndarray, links: np.ndarray):
        """Edges that join each query with its rows, leaving out rows that are joined already."""
        src, dst = [own], [self.nodes[row[first]]]
        for at, n in zip(first.tolist(), links.tolist(), strict=True):
            if n == 1:
                continue
            head = self.root[row[at : at + n]]
            while (self.root[head] != head).any():
                head = self.root[head]
            heads = np.unique(head)
            self.root[row[at : at + n]] = heads[0]
            if len(heads) > 1:
                self.root[heads[1:]] = heads[0]
                src.append(np.repeat(self.nodes[heads[:1]], len(heads) - 1))
                dst.append(self.nodes[heads[1:]])
        src, dst = np.concatenate(src), np.concatenate(dst)
        yield src, dst, np.full(len(src), self.number), EDGE, np.zeros(len(src), np.int64)


def _searched(least: float, recall: float, single: bool):
    """Links of the queries of a partition; its rows are one task's: the shard's graph first, then queries."""

    def search(batches):
        shard, names = None, [f.split()[0] for f in LINK.split(", ")]
        for b in batches:
            for lo in range(0, b.num_rows, BATCH_ROWS):
                t = b.slice(lo, BATCH_ROWS)
                part = t.column(1).to_numpy()
                if (part == 0).any():
                    row = t.slice(int(np.argmin(part)), 1).to_pylist()[0]
                    vectors = _unit(row["vectors"], row["dim"], single)
                    shard = Shard(np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["counts"], np.int64), vectors, Graph.load(vectors, row["graph"]), row["shard"], least, recall)
                t = t.filter(pa.array(part == 1))
                if not t.num_rows:
                    continue
                own, copies = t.column(4).to_numpy(), t.column(5).to_numpy()
                q = _unit(b"".join(t.column(8).to_pylist()), t.column(3)[0].as_py(), single)
                for src, dst, number, kind, n in shard.search(own, t.column(2).to_numpy(), copies, q):
                    if len(src):
                        columns = [pa.array(src), pa.array(dst), pa.array(number.astype(np.int32)), pa.array(np.full(len(src), kind, np.int32)), pa.array(n.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return search


def _layout(nodes: DataFrame, single: bool) -> tuple[DataFrame, int, int]:
    """(dim, shards, blocks, graph_at, task_at) for each length of vectors, and the numbers of graphs and tasks."""
    rows, graphs, tasks = [], 0, 0
    for dim, n in nodes.groupBy("dim").count().sort("dim").toLocalIterator():
        most = max(1, min(SHARD_ROWS, SHARD_BYTES // (dim * (4 if single else 8))))
        shards, blocks = max(-(-n // most), min(SHARDS, -(-n // SHARD_LEAST))), -(-n // BLOCK_ROWS)
        rows.append((dim, shards, blocks, graphs, tasks))
        graphs, tasks = graphs + shards, tasks + shards * blocks
    return nodes.sparkSession.createDataFrame(rows, "dim int, shards int, blocks int, graph_at int, task_at int"), graphs, tasks


def _found(nodes: DataFrame, least: float, recall: float, single: bool) -> DataFrame:
    """Rows of ``LINK`` for the distinct vectors (node, dim, key, n)."""
    layout, graphs, tasks = _layout(nodes, single)
    order = F.xxhash64("key")
    dealt = nodes.join(layout, "dim").withColumns({"order": order, "shard": F.pmod(F.xxhash64(order, F.lit(1)), "shards").cast("int"), "block": F.pmod(F.xxhash64(order, F.lit(2)), "blocks").cast("int")})
    parts = dealt.select((F.col("graph_at") + F.col("shard")).alias("task"), "shard", "dim", "node", "n", "key", "order").repartitionById(max(1, graphs), "task")
    built = checkpointed(parts.sortWithinPartitions("order", "node").drop("order").mapInArrow(_built(single), TASK))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    task = lambda shard, block: (F.col("task_at") + shard * F.col("blocks") + block).cast("long").alias("task")
    held = built.join(layout, "dim").withColumn("block", every(F.col("blocks"))).withColumn("task", task(F.col("shard"), F.col("block")))
    none = lambda c: F.lit(None).cast("binary").alias(c)
    asked = dealt.withColumn("in", every(F.col("shards"))).select(
        task(F.col("in"), F.col("block")), F.lit(1).alias("part"), "shard", "dim", "node", "n", none("nodes"), none("counts"), F.col("key").alias("vectors"), none("graph")
    )
    met = held.select(*asked.columns).union(asked).repartitionById(max(1, tasks), F.col("task").cast("int")).sortWithinPartitions("part")
    return checkpointed(met.mapInArrow(_searched(least, recall, single), LINK))


def _others(found: DataFrame) -> DataFrame:
    """(node, others): the vectors that a node links with, its own copies left out.

    A link that one end has found counts for both, unless the other end has given a number for that shard.
    """
    many = found.where(F.col("kind") == COUNT).select("src", "shard", "n")
    pairs = found.where(F.col("kind") == PAIR).groupBy("src", "dst").agg(F.first("shard").alias("shard"), F.first("n").alias("n"))
    few = pairs.join(many, ["src", "shard"], "left_anti").select("src", "n")
    return few.union(many.select("src", "n")).groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("others"))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = checkpointed(_keyed(df, id_col, vector_col))
    same = rows.where("key is not null").groupBy("dim", "key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    nodes = checkpointed(same.withColumn("node", F.monotonically_increasing_id()))
    found = _found(nodes, least, recall, _single(df, vector_col))
    parts = connected_components(found.where(F.col("kind") == EDGE).select("src", "dst"))
    rooted = nodes.join(_others(found), "node", "left").join(parts, "node", "left")
    rooted = rooted.select("dim", "key", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = checkpointed(rooted.join(heads, "root").select("dim", "key", "n_links", "component_id"))
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("key is not null").join(members, ["dim", "key"]).select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
