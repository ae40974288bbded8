"""Vector code compression: codebooks of vector parts, trained by Lloyd rounds over partition-local cover trees.

A component x counts as the integer floor(1024 * x), so that all sums and distances are exact. Vectors are cut into
``PARTS`` consecutive parts. Runs of up to ``RUN`` vectors of a partition become one row of a table: their ids, their
labels, and for each part a cover tree of the distinct parts in the run. Points lie in the order of the tree, so that a
subtree is a range of them, and cumulative sums give its sum at once. A round walks the trees from their tops: where the
gap between the nearest and the second nearest entry of the codebook exceeds twice the radius of a subtree, the triangle
inequality gives all of it to the nearest; other nodes are opened, down to single points, which are compared exactly.
Tasks add up what they assigned (an entry a row), Spark adds the tasks, and the next codebook, of a fixed size, is worked
out from at most ``PARTS * ENTRIES`` rows. The trees are built once and checkpointed.

Rows whose vector is null, empty, or holds null or non-finite components are dropped, as are vectors of another length than
that of the smallest kept id. Lengths that ``PARTS`` does not divide are cut at floor(i * length / PARTS). Null ids come
last in the order of ids; rows that repeat an id are ordered by their vectors and each get a code. Fewer rows than entries
give a smaller codebook; no rows give no rows. Components whose squared distances pass 63 bits raise an error.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from reportloom.llm.common import checkpointed, join_counted, shuffle_partitions

SCALE, PARTS, ENTRIES, ROUNDS, RUN = 1024, 4, 256, 4, 2048


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer arrays: by products in doubles where those are exact."""
    top = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    bound = 4 * top * top * max(1, a.shape[1])
    if bound < 1 << 52:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]).astype(np.int64)
    if bound >= 1 << 63:
        raise ValueError(f"components up to {top / SCALE:g} are too large for exact distances in 64 bits")
    return np.stack([((a - y) ** 2).sum(1) for y in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


class CoverTree:
    """Nested nets of distinct integer points; every node's points are a range of the points in the order of the tree.

    Nets are built from the points up: centres of a level are more than its radius apart, every centre of the level below
    lies within that radius of one, and radii double. A centre that covers itself alone has no node of its own.
    """

    FIELDS = ("points", "counts", "centre", "radius", "start", "end", "first", "children", "place")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.sums = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points * self.counts[:, None], 0)])
        self.totals = np.concatenate([[0], np.cumsum(self.counts)])

    @classmethod
    def build(cls, rows: np.ndarray) -> CoverTree:
        """``place[i]``: where row i's point stands in the order of the tree."""
        points, of, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        n, of = len(points), of.reshape(-1)
        d = squared_distances(points, points)
        centre, below = list(range(n)), [[] for _ in range(n)]
        alive, node = np.arange(n), np.arange(n)  # centres of the level, and the node that each stands for
        reach = 1
        while len(alive) > 1:
            near = d[np.ix_(alive, alive)]
            np.fill_diagonal(near, np.iinfo(np.int64).max)
            while reach < near.min():
                reach *= 4
            close = near <= reach
            free, lead = np.ones(len(alive), bool), np.ones(len(alive), bool)
            for c in np.nonzero(close.any(1))[0]:
                if free[c]:
                    free[c] = False
                    members = np.nonzero(close[c] & free)[0]
                    if len(members):
                        free[members] = lead[members] = False
                        below.append([int(node[c]), *map(int, node[members])])
                        centre.append(int(alive[c]))
                        node[c] = len(below) - 1
            alive, node = alive[lead], node[lead]
            reach *= 4
        order, start, end = [], [0] * len(below), [0] * len(below)
        stack = [(int(node[0]), False)]
        while stack:
            k, done = stack.pop()
            if done or not below[k]:
                if not done:
                    start[k] = len(order)
                    order.append(centre[k])
                end[k] = len(order)
            else:
                start[k] = len(order)
                stack.append((k, True))
                stack += [(c, False) for c in reversed(below[k])]
        order = np.array(order)
        radius = [0.0 if not below[k] else float(np.sqrt(d[centre[k], order[start[k] : end[k]]].max())) for k in range(len(below))]
        at = np.empty(n, np.int32)
        at[order] = np.arange(n, dtype=np.int32)
        first = np.concatenate([[0], np.cumsum([len(b) for b in below])])
        # The top is the last node that was made.
        return cls(points=points[order], counts=counts[order], centre=at[np.array(centre)], radius=np.array(radius), start=np.array(start, np.int32), end=np.array(end, np.int32),
                   first=first.astype(np.int32), children=np.array([c for b in below for c in b], np.int32), place=at[of])

    def assign(self, codebook: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, ends, entries) of ranges that together are all points, each range with its nearest entry.

        Equal distances go to the lower entry: a range wider than a point is only given to an entry that is strictly nearest.
        """
        nodes = np.array([len(self.radius) - 1])
        while len(nodes):
            d = squared_distances(self.points[self.centre[nodes]], codebook)
            best = d.argmin(1)
            rows = np.arange(len(nodes))
            least = np.sqrt(d[rows, best].astype(np.float64))
            d[rows, best] = np.iinfo(np.int64).max
            second = np.sqrt(d.min(1).astype(np.float64))
            r = self.radius[nodes]
            settled = (r == 0) | (second - least > 2 * r * (1 + 1e-9) + 1e-6)
            yield self.start[nodes[settled]], self.end[nodes[settled]], best[settled]
            left = nodes[~settled]
            nodes = np.concatenate([self.children[self.first[k] : self.first[k + 1]] for k in left]) if len(left) else left

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as found:
            return cls(**{name: found[name] for name in cls.FIELDS})


def _cuts(length: int) -> list[int]:
    return [i * length // PARTS for i in range(PARTS + 1)]


def _built(length: int, label: pa.DataType):
    cuts = _cuts(length)
    kinds = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(label)), ("trees", pa.list_(pa.binary()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, RUN):
                run = b.slice(at, RUN)
                flat = run.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(run.num_rows, length)
                trees = [CoverTree.build(flat[:, lo:hi]).dump() for lo, hi in zip(cuts, cuts[1:])]
                one = lambda c, t: pa.ListArray.from_arrays(pa.array([0, run.num_rows], pa.int32()), c.cast(t))
                yield pa.RecordBatch.from_arrays([one(run.column(0), pa.int64()), one(run.column(1), label), pa.array([trees], pa.list_(pa.binary()))], schema=kinds)

    return build


def _moved(codebooks: list[np.ndarray]):
    """Rows of (part, entry, number of points, their sums), added up over the trees of a task."""
    width = max(c.shape[1] for c in codebooks)
    names = ["part", "entry", "n", *[f"s{j}" for j in range(width)]]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), 1 + width), np.int64) for c in codebooks]
        for b in batches:
            for trees in b.column(0).to_pylist():
                for p, data in enumerate(trees):
                    tree, book = CoverTree.load(data), codebooks[p]
                    for start, end, entry in tree.assign(book):
                        np.add.at(total[p][:, 0], entry, tree.totals[end] - tree.totals[start])
                        np.add.at(total[p][:, 1 : 1 + book.shape[1]], entry, tree.sums[end] - tree.sums[start])
        found = np.concatenate([np.column_stack([np.full(len(t), p), np.arange(len(t)), t]) for p, t in enumerate(total)])
        found = found[found[:, 2] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], names)

    return move, ", ".join(f"{n} long" for n in names)


def _coded(codebooks: list[np.ndarray], label: pa.DataType):
    kinds = pa.schema([("vec_id", pa.int64()), ("label", label), ("code", pa.string()), ("error", pa.int64())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                codes, error = [], 0
                for p, data in enumerate(b.column(2)[k].as_py()):
                    tree = CoverTree.load(data)
                    own = np.empty(len(tree.points), np.int64)
                    for start, end, entry in tree.assign(codebooks[p]):
                        for s, e, x in zip(start, end, entry):
                            own[s:e] = x
                    far = ((tree.points - codebooks[p][own]) ** 2).sum(1)
                    codes.append(own[tree.place])
                    error = error + far[tree.place]
                texts = [bytes(row).hex() for row in np.stack(codes, 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1).flatten(), b.column(1).slice(k, 1).flatten(), pa.array(texts, pa.string()), pa.array(error, pa.int64())], schema=kinds)

    return code


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept vector; runs jobs.

    At most 256 ``entries``, so that an index has two hex digits.
    """
    v = F.col(vector_col)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    kept = df.where(v.isNotNull() & (F.size(v) > 0) & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(v, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("x"))
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    top = kept.orderBy(*order).select(F.size("x").alias("n")).first()
    label_type = kept.schema["label"].dataType
    if top is None:
        empty = T.StructType().add("vec_id", "long").add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string")
        return df.sparkSession.createDataFrame([], empty)
    length = top.n
    kept = kept.where(F.size("x") == length)
    start = np.array([r.x for r in kept.orderBy(*order).limit(entries).select("x").collect()], np.int64)
    cuts = _cuts(length)
    codebooks = [start[:, lo:hi].copy() for lo, hi in zip(cuts, cuts[1:])]
    arrow = to_arrow_type(label_type)
    schema = T.StructType().add("ids", T.ArrayType(T.LongType())).add("labels", T.ArrayType(label_type)).add("trees", T.ArrayType(T.BinaryType()))
    trees = checkpointed(kept.mapInArrow(_built(length, arrow), schema))
    for _ in range(rounds):
        move, columns = _moved(codebooks)
        sums = [F.sum(F.col(c.split()[0]).cast("decimal(38,0)")).alias(c.split()[0]) for c in columns.split(", ")[2:]]
        for r in trees.select("trees").mapInArrow(move, columns).groupBy("part", "entry").agg(*sums).collect():  # at most PARTS * entries rows
            book = codebooks[r.part]
            book[r.entry] = [int(r[f"s{j}"]) // int(r.n) for j in range(book.shape[1])]
    digest = hashlib.sha256(",".join(str(x) for book in codebooks for x in book.reshape(-1).tolist()).encode()).hexdigest()
    coded = trees.mapInArrow(_coded(codebooks, arrow), T.StructType().add("vec_id", "long").add("label", label_type).add("code", "string").add("error", "long"))
    coded = checkpointed(coded)  # used twice: for the sums of labels and for the rows
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows_"))
    joined = join_counted(coded, totals, ["label"], "rows_", shuffle_partitions(df.sparkSession))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
