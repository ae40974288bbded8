"""A navigable small-world graph with layers, built and searched in batches of rows with numpy.

Used inside Spark tasks, one graph for each shard of the vectors; see ``embedding_dedup``. Similarity is the dot product
of unit vectors.
"""

from __future__ import annotations

import pickle

import numpy as np

M, M0, BUILD_BEAM, BATCH, EXPAND = 12, 24, 48, 256, 4
#: Marks of rows seen (one for each query and row) that a search holds at a time.
SEEN = 1 << 25


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k largest of each row, descending."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


class Layer:
    """Neighbour lists over local row numbers; -1 fills up."""

    def __init__(self, rows: int, width: int):
        self.near = np.full((rows, width), -1, np.int32)


def beam(vectors: np.ndarray, near: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, similarities) of the best ``width`` found for each query, descending; -1 and -inf fill up.

    All queries of the batch move together; each step opens the ``EXPAND`` best unopened rows of every beam.
    """
    b, n = len(queries), len(near)
    line = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), bool)  # the last column stands for -1
    seen[:, n] = True
    seen[line, entry[:, None]] = True
    rows = np.full((b, width), -1, np.int32)
    sims = np.full((b, width), -np.inf, np.float32)
    opened = np.ones((b, width), bool)
    rows[:, 0], opened[:, 0] = entry, False
    sims[:, 0] = np.einsum("bd,bd->b", queries, vectors[entry])
    live = np.arange(b)
    while len(live):
        waiting = np.where(opened[live], -np.inf, sims[live])
        at = _top(waiting, min(EXPAND, width))
        good = np.take_along_axis(waiting, at, 1) > -np.inf
        keep = good.any(axis=1)
        live, at, good = live[keep], at[keep], good[keep]
        if not len(live):
            break
        opened[live[:, None], at] = True
        heads = np.where(good, rows[live[:, None], at], -1)
        found = np.where(heads[:, :, None] >= 0, near[heads], -1).reshape(len(live), -1)
        found[seen[live[:, None], found]] = -1
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        seen[live[:, None], found] = True
        who, col = np.nonzero(found >= 0)
        fresh = np.full(found.shape, -np.inf, np.float32)
        ids = found[who, col]
        fresh[who, col] = np.einsum("kd,kd->k", queries[live[who]], vectors[ids])
        all_rows = np.concatenate([rows[live], found], axis=1)
        all_sims = np.concatenate([sims[live], fresh], axis=1)
        all_open = np.concatenate([opened[live], fresh == -np.inf], axis=1)
        best = _top(all_sims, width)
        rows[live], sims[live], opened[live] = (np.take_along_axis(x, best, 1) for x in (all_rows, all_sims, all_open))
    return rows, sims


def _diverse(vectors: np.ndarray, rows: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """For each line of candidates (descending), those nearer to the line's owner than to any one chosen before.

    Places left over go to the nearest of the others.
    """
    b, c = rows.shape
    x = vectors[np.maximum(rows, 0)]
    among = np.matmul(x, x.transpose(0, 2, 1))
    worst = np.full((b, c), -np.inf, np.float32)  # each candidate's similarity to the nearest chosen one
    taken = np.zeros((b, c), bool)
    count = np.zeros(b, int)
    for k in range(c):
        ok = (rows[:, k] >= 0) & (sims[:, k] > worst[:, k]) & (count < width)
        taken[:, k] = ok
        count += ok
        worst = np.where(ok[:, None], np.maximum(worst, among[:, k]), worst)
    rank = np.where(rows < 0, -np.inf, sims + np.where(taken, 4.0, 0.0))
    best = _top(rank, width)
    out = np.take_along_axis(rows, best, 1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """Layers over ``vectors``; layer k holds the first ``sizes[k]`` rows, so rows must come in random order."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        sizes = [len(vectors)]
        while sizes[-1] > 4 * M * M:
            sizes.append(sizes[-1] // M)
        self.layers: list[Layer] = []  # from the top
        for k, size in enumerate(reversed(sizes)):
            layer = Layer(size, M0 if k == len(sizes) - 1 else M)
            self._fill(layer)
            self.layers.append(layer)

    def _entry(self, queries: np.ndarray) -> np.ndarray:
        """The row where the search of the next layer begins, by greedy descent through the finished ones."""
        at = np.zeros(len(queries), np.int32)
        for layer in self.layers:
            at = beam(self.vectors, layer.near, queries, at, EXPAND)[0][:, 0]
        return at

    def _fill(self, layer: Layer) -> None:
        near, v, width = layer.near, self.vectors, layer.near.shape[1]
        done = min(len(near), BUILD_BEAM)
        sims = v[:done] @ v[:done].T
        np.fill_diagonal(sims, -np.inf)
        order = _top(sims, max(1, done - 1))
        if done > 1:
            near[:done] = _diverse(v, order.astype(np.int32), np.take_along_axis(sims, order, 1), width)
        while done < len(near):
            new = np.arange(done, min(len(near), done + min(BATCH, done)))
            q = v[new]
            entry = self._entry(q)
            rows, sims = beam(v, near[:done], q, np.where(entry < done, entry, 0), BUILD_BEAM)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            others = _top(own, min(width, len(new)))
            rows = np.concatenate([rows, np.where(np.take_along_axis(own, others, 1) > -np.inf, new[others], -1).astype(np.int32)], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, others, 1)], axis=1)
            best = _top(sims, BUILD_BEAM)
            near[new] = _diverse(v, np.take_along_axis(rows, best, 1), np.take_along_axis(sims, best, 1), width)
            self._back(near, new)
            done = new[-1] + 1

    def _back(self, near: np.ndarray, new: np.ndarray) -> None:
        """Adds the edges back to the new rows; full lists keep a diverse choice."""
        v, width = self.vectors, near.shape[1]
        ends, owners = near[new].ravel(), np.repeat(new, width)
        owners, ends = owners[ends >= 0], ends[ends >= 0]
        order = np.argsort(ends, kind="stable")
        ends, owners = ends[order], owners[order]
        touched, first, count = np.unique(ends, return_index=True, return_counts=True)
        for lo in range(0, len(touched), BATCH):
            t, f, c = touched[lo : lo + BATCH], first[lo : lo + BATCH], np.minimum(count[lo : lo + BATCH], 4 * width)
            more = np.full((len(t), c.max()), -1, np.int32)
            col = np.arange(c.max())[None, :]
            inside = col < c[:, None]
            more[inside] = owners[(f[:, None] + col)[inside]]
            rows = np.concatenate([near[t], more], axis=1)
            rows.sort(axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
            sims = np.where(rows >= 0, np.einsum("td,tcd->tc", v[t], v[np.maximum(rows, 0)]), -np.inf)
            best = _top(sims, min(rows.shape[1], 3 * width))
            near[t] = _diverse(v, np.take_along_axis(rows, best, 1), np.take_along_axis(sims, best, 1), width)

    def dearest(self) -> int:
        """The beam's width from which on it costs more than all rows."""
        n, dim = self.vectors.shape
        return min(n, int((n * dim / 16) ** 0.5) + 1)

    def near_rows(self, queries: np.ndarray, least: float, width: int):
        """(query, row) numbers of the rows found with a similarity of at least ``least``.

        A beam that is filled with such rows is widened until it holds others too. A beam costs its width squared; from
        ``dearest`` on a query is compared with all rows, which is cheaper and misses none.
        """
        n, dearest = len(self.vectors), self.dearest()
        step = max(16, min(BATCH, SEEN // n))
        for lo in range(0, len(queries), step):
            todo = np.arange(lo, min(len(queries), lo + step))
            beam_width = min(width, n)
            while len(todo):
                q = queries[todo]
                if beam_width >= dearest:
                    who, row = np.nonzero(q @ self.vectors.T >= least)
                    yield todo[who], row
                    break
                entry = np.zeros(len(q), np.int32)
                for layer in self.layers[:-1]:
                    entry = beam(self.vectors, layer.near, q, entry, EXPAND)[0][:, 0]
                rows, sims = beam(self.vectors, self.layers[-1].near, q, entry, beam_width)
                full = sims[:, -1] >= least
                who, col = np.nonzero((sims >= least) & ~full[:, None])
                yield todo[who], rows[who, col]
                todo, beam_width = todo[full], min(n, 4 * beam_width)

    def dump(self) -> bytes:
        return pickle.dumps([layer.near for layer in self.layers], protocol=5)

    @classmethod
    def load(cls, vectors: np.ndarray, blob: bytes) -> Graph:
        graph = cls.__new__(cls)
        graph.vectors = np.ascontiguousarray(vectors, np.float32)
        graph.layers = []
        for near in pickle.loads(blob):
            layer = Layer(0, near.shape[1])
            layer.near = near
            graph.layers.append(layer)
        return graph
