"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a stated query set; every document is searched, whole, for each of its items. Documents are read as
passages: for each item, windows of blocks that hold every stretch of ``STRETCH`` items. Passages are TF-IDF vectors
over the words of the items, projected to the leading right singular vectors that a distributed randomised SVD finds
(and to the items' own directions that it lacks). A window whose product with an item reaches the least one that
``COVER`` of the item's words can have, and that holds words of so many of its places, is a candidate. Both bounds follow
from ``COVER`` alone: whatever the document frequencies, no stretch that the confirmation would take is left out. A
candidate is confirmed if a longest common subsequence of words covers ``COVER`` of the item, and the item's answer (its
last words, ``ANSWER`` of them) is covered by half at least, or the whole by ``SURE``. ``cosine`` is told of confirmed
windows only and decides nothing; it takes words of no item of a block as never seen.

Document frequencies count all documents. The SVD is the index; it is fitted on all items and a bounded sample of
documents (``FIT_ROWS``) but used on every passage. Items go in blocks of ``BLOCK`` with an index each, and ``TOGETHER`` of
them are searched in one pass over the documents, so that what a task holds is bounded for any benchmark.

Null and empty texts (of either table) contain and match nothing. An item of under ``LEAST`` words is found where it stands
as it is, word by word (cosine and coverage 1, its first place). Repeated rows
and ids stay repeated; an item id that occurs twice is two items. Rows with null ids are searched too. Extra columns
are ignored. No items or no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import checkpointed

#: With more directions than a block has items, the index tells all of them apart.
RANK, OVERSAMPLE, ROUNDS = 256, 16, 2
FIT_ROWS, FIT_TASKS = 2_000, 8
#: Words whose sums travel as one cell in the fit.
SLICE = 512
#: An item counts as so many passages in the fit; the index is there to tell items apart.
ITEM_WEIGHT = 1_000
COVER, SURE, STRETCH = 0.6, 0.8, 1.5
ANSWER, LEAST, BLOCK = 5, 6, 200
#: Items searched in one pass over the documents: what a task holds of the benchmark.
TOGETHER = 10_000
#: Words of a block; windows are runs of blocks.
WINDOW = 8
#: Words searched together, and blocks whose sums are held at a time.
WORDS, BLOCKS = 1 << 16, 512

FOUND = "doc_id long, item_id long, cosine double, coverage double, first_word long, end_word long"
#: Bytes that part words: all of ASCII but letters, digits and the underline. Other characters belong to words.
_PARTS = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8").translate(_PARTS).split()


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the row as the bits of one integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & at.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Items:
    """A block of benchmark items: their words as numbers, and length groups for windows."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in rows for w in ws}))}
        self.words = [[self.vocabulary[w] for w in ws] for _, ws in rows]
        self.groups: dict[int, list[int]] = {}
        for k, ws in enumerate(self.words):
            size = WINDOW
            while size * 1.42 < len(ws):
                size *= 2
            self.groups.setdefault(size, []).append(k)


class Query:
    """The items of one pass over the documents: blocks of long ones, and short ones that are searched as runs of words."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        split = [(i, w) for i, t in rows if (w := words_of(t))]
        long = [x for x in split if len(x[1]) >= LEAST]
        self.blocks = [Items(long[at : at + BLOCK]) for at in range(0, len(long), BLOCK)]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        #: For each block, its number of each word of all items; the last is for other words.
        self.maps = [np.array([*(b.vocabulary.get(w, -1) for w in self.vocabulary), -1], np.int32) for b in self.blocks]
        self.short: dict[int, dict[tuple, list]] = {}
        for i, ws in split:
            if len(ws) < LEAST:
                self.short.setdefault(len(ws), {}).setdefault(tuple(self.vocabulary[w] for w in ws), []).append(i)

    def numbers(self, text: str | None) -> np.ndarray:
        """The text's words as numbers, -1 for words of no item."""
        return np.array(list(map(self.vocabulary.get, words_of(text), repeat(-1))), np.int32)

    def runs(self, numbers: np.ndarray) -> Iterator[tuple]:
        """(item id, first word) of each short item that the text holds as it stands."""
        for n, items in self.short.items():
            first = np.isin(numbers[: len(numbers) - n + 1], [ws[0] for ws in items])
            found: dict[tuple, int] = {}
            for at in np.nonzero(first)[0].tolist():
                found.setdefault(tuple(numbers[at : at + n].tolist()), at)
            yield from ((i, n, at) for ws, at in found.items() for i in items.get(ws, ()))


def document_frequencies(docs: DataFrame, query: Query) -> tuple[np.ndarray, int]:
    """Documents that hold each word of the items, and the number of documents. Counted over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(query)

    def count(batches):
        held, rows = np.zeros(len(shared.value.vocabulary) + 1, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                seen = np.unique(shared.value.numbers(text))
                held[seen[seen >= 0]] += 1
                rows += 1
        held[-1] = rows
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["word", "n"])

    out = np.zeros(len(query.vocabulary) + 1, np.int64)
    # As many rows as the items have words: bounded by the query set. In one job, not one for each partition.
    found = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out[found["word"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


def _passages(numbers: np.ndarray, size: int) -> list[np.ndarray]:
    return [w[w >= 0] for s in range(0, max(1, len(numbers) - size // 2), size) if len(w := numbers[s : s + size])]


def fit_sample(docs: DataFrame) -> DataFrame:
    """Texts of at most ``FIT_ROWS`` documents, those of the smallest hashes, read once and used in every round."""
    hashed = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text", "doc_id").alias("h"))
    last = hashed.select("h").orderBy("h").limit(FIT_ROWS).agg(F.max("h")).first()[0]  # hashes alone are compared
    return checkpointed(hashed.where(F.col("h") <= F.lit(last)).limit(FIT_ROWS).select("text").repartition(FIT_TASKS))


def fit_index(sample: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """(words, rank): leading right singular vectors of the passages' TF-IDF matrix A, by randomised subspace iteration.

    Each round multiplies by A'A. Tasks give their sums in slices of ``SLICE`` words, which are added on the executors, in
    the order of the tasks: the driver gets one matrix of the fixed size words x rank, not one from each task.
    """
    spark, n = sample.sparkSession, len(idf)
    rank = min(RANK + OVERSAMPLE, n)
    basis = np.random.default_rng(7).standard_normal((n, rank))
    size = max(items.groups)
    own = [np.array(w, np.int32) for w in items.words]

    def gram(passages, q):
        out = np.zeros_like(q)
        for p in passages:
            if len(p):
                at, tf = np.unique(p, return_counts=True)
                x = tf * idf[at]
                x = x / np.sqrt((x * x).sum() or 1.0)
                out[at] += x[:, None] * (x @ q[at])[None, :]
        return out

    def add(slices):
        each = [np.frombuffer(x.as_py(), np.float64) for x in slices.sort_by("task").column("sum")]
        return pa.table({"at": slices.column("at").slice(0, 1), "sum": pa.array([sum(each[1:], each[0]).tobytes()], pa.binary())})

    for _ in range(ROUNDS):
        q = np.linalg.qr(basis)[0]
        shared = spark.sparkContext.broadcast((items, q))

        def part(batches):
            held, q = shared.value  # noqa: B023
            out = np.zeros_like(q)
            numbers = lambda text: np.array(list(map(held.vocabulary.get, words_of(text), repeat(-1))), np.int32)
            for b in batches:
                for text in b.column(0).to_pylist():
                    out += gram(_passages(numbers(text), size), q)
            task = TaskContext.get().partitionId()
            for at in range(0, n, SLICE):
                yield pa.RecordBatch.from_pydict({"at": [at], "task": [task], "sum": [out[at : at + SLICE].astype(np.float64).tobytes()]})

        sums = sample.mapInArrow(part, "at long, task long, sum binary").groupBy("at").applyInArrow(add, "at long, sum binary").coalesce(FIT_TASKS).toArrow()
        shared.destroy()
        basis = gram(own, q) * ITEM_WEIGHT
        for at, found in zip(sums["at"].to_pylist(), sums["sum"], strict=True):
            basis[at : at + SLICE] += np.frombuffer(found.as_buffer(), np.float64).reshape(-1, rank)
    u, s, _ = np.linalg.svd(basis, full_matrices=False)
    return u[:, : min(RANK, int((s > s[0] * 1e-9).sum()))]


def least_product(words: list[int], idf: np.ndarray) -> float:
    """The smallest TF-IDF product with an item of any passage that holds ``COVER`` of the item's words."""
    values, counts = np.unique(words, return_counts=True)
    each = np.sort(np.repeat(counts * idf[values] ** 2, counts))
    return float(each[: -int(-COVER * len(words) // 1)].sum())


class Search:
    """Finds the items of a block in whole texts."""

    def __init__(self, items: Items, idf: np.ndarray, rare: float, vectors: np.ndarray):
        self.items = items
        self.weight = np.append(idf, rare)  # the last is for words of no item
        own = np.zeros((len(items.ids), len(idf)))
        for k, words in enumerate(items.words):
            np.add.at(own[k], words, idf[words])
        # Directions of items that the index lacks are added, so that no product is too small.
        missing = own - (own @ vectors) @ vectors.T
        missing = missing[np.linalg.norm(missing, axis=1) > 1e-9 * np.linalg.norm(own, axis=1)]
        if len(missing):
            u, s, _ = np.linalg.svd(missing.T, full_matrices=False)
            vectors = np.linalg.qr(np.hstack([vectors, u[:, s > s[0] * 1e-9]]))[0]
        self.norms = np.linalg.norm(own, axis=1)
        # Blocks that surely hold any stretch of ``STRETCH`` items; items of equal widths side by side.
        blocks = [-(-int(STRETCH * len(w) + 0.5) // WINDOW) + 1 for w in items.words]
        self.order = sorted(range(len(blocks)), key=blocks.__getitem__)
        width = np.array([blocks[k] for k in self.order])
        self.widths = [(int(x), slice(*np.searchsorted(width, [x, x + 1]))) for x in np.unique(width)]
        # A window's products with the items are the sums of its words' products.
        products = ((vectors * idf[:, None]) @ (own @ vectors).T)[:, self.order]
        # Nearly all are 0; what is left out is far below the margin of ``least``.
        word, self.column = np.nonzero(np.abs(products) > 1e-9 * np.abs(products).max())
        self.value, self.starts = products[word, self.column], np.searchsorted(word, np.arange(len(idf) + 1))
        self.least = np.array([least_product(items.words[k], idf) for k in self.order]) * (1 - 1e-3)
        self.distinct = [np.unique(items.words[k], return_counts=True) for k in self.order]

    def find(self, texts: Iterable[np.ndarray]) -> Iterator[tuple[int, int, float, float, int, int]]:
        """(text's place, item, cosine, coverage, first word, end word) of each confirmed item, at its best place.

        ``texts`` are the texts' words as the block's numbers.
        """
        held: list[tuple[int, np.ndarray]] = []
        n = 0
        for place, numbers in enumerate(texts):
            if (numbers >= 0).sum() < LEAST * COVER:
                continue
            held.append((place, numbers))
            n += len(numbers)
            if n >= WORDS:
                yield from self._find(held)
                held, n = [], 0
        if held:
            yield from self._find(held)

    def _find(self, texts: list[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        """Texts one after another, each from a new block on."""
        sizes = np.array([-(-len(x) // WINDOW) for _, x in texts])
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        numbers = np.full(firsts[-1] * WINDOW, -1, np.int32)
        for (_, x), f in zip(texts, firsts, strict=False):
            numbers[f * WINDOW : f * WINDOW + len(x)] = x
        of = np.repeat(np.arange(len(texts)), sizes)
        where = np.nonzero(numbers >= 0)[0]
        keys = np.sort(numbers[where].astype(np.int64) * len(numbers) + where)
        best: dict[tuple[int, int], tuple[float, float, int, int]] = {}
        for column, start, end in self._windows(numbers, firsts, of):
            keep = self._holds(column, start * WINDOW, end * WINDOW, keys, len(numbers))
            k = self.order[column]
            start, end = start[keep], end[keep]
            # Neighbouring windows of a text are first tried as one: it covers no less than any of them.
            cuts = np.nonzero((start[1:] != start[:-1] + 1) | (of[start[1:]] != of[start[:-1]]))[0] + 1
            for run in np.split(np.arange(len(start)), cuts):
                if len(run):
                    t = int(of[start[run[0]]])
                    self._confirm(k, t, texts[t][1], (start[run] - firsts[t]) * WINDOW, (end[run] - firsts[t]) * WINDOW, best)
        for (t, k), found in sorted(best.items()):
            yield texts[t][0], k, *found

    def _windows(self, numbers: np.ndarray, firsts: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, start, end) in blocks, of the windows whose product with an item could belong to ``COVER`` of it."""
        found: dict[int, list] = {}
        total, widest = len(of), self.widths[-1][0]
        for lo in range(0, total, BLOCKS):
            hi = min(total, lo + BLOCKS + widest)
            words = numbers[lo * WINDOW : hi * WINDOW]
            place = np.nonzero(words >= 0)[0]
            first, count = self.starts[words[place]], np.diff(self.starts)[words[place]]
            entry = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            cell = np.repeat((place // WINDOW + 1) * len(self.order), count) + self.column[entry]
            sums = np.bincount(cell, self.value[entry], (hi - lo + 1) * len(self.order)).reshape(hi - lo + 1, -1)
            np.cumsum(sums, axis=0, out=sums)
            at = np.arange(lo, min(total, lo + BLOCKS))
            text_first, text_end = firsts[of[at]], firsts[of[at] + 1]
            for width, columns in self.widths:
                # A window that its text's end cuts lies in the one before it, unless it is the text's first.
                start = at[(at + width <= text_end) | (at == text_first)]
                end = np.minimum(start + width, firsts[of[start] + 1])
                near = sums[end - lo, columns] - sums[start - lo, columns] >= self.least[columns]
                w, c = np.divmod(np.flatnonzero(near), near.shape[1])
                order = np.argsort(c, kind="stable")
                w, c = w[order], c[order] + columns.start
                for part in np.split(np.arange(len(c)), np.nonzero(c[1:] != c[:-1])[0] + 1):
                    if len(part):
                        found.setdefault(int(c[part[0]]), []).append((start[w[part]], end[w[part]]))
        for column, parts in found.items():
            yield column, *(np.concatenate(x) for x in zip(*parts, strict=True))

    def _holds(self, column: int, start: np.ndarray, end: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        """Whether windows hold words of ``COVER`` of the item's places. ``keys``: word * n + place of all words, sorted."""
        values, counts = self.distinct[column]
        low = values[None, :] * n + start[:, None]
        at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
        inside = (keys[at] >= low) & (keys[at] < values[None, :] * n + end[:, None])
        return inside @ counts >= COVER * counts.sum()

    def _confirm(self, k: int, t: int, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, best: dict) -> None:
        item = self.items.words[k]

        def stretch(start: int, end: int) -> tuple[int, int, list[int], float]:
            slack = max(0, 2 * len(item) - (end - start)) // 2 + 1
            a, b = max(0, start - slack), min(len(numbers), end + slack)
            around = numbers[a:b].tolist()
            return a, b, around, common_subsequence(item, around) / len(item)

        if len(starts) > 1 and stretch(int(starts[0]), int(ends[-1]))[3] < COVER:
            return
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if (t, k) in best and best[t, k][1] >= 1.0:
                return
            a, b, around, cover = stretch(start, end)
            if cover < COVER or (t, k) in best and cover <= best[t, k][1]:
                continue
            answer = common_subsequence(item[-ANSWER:], around) / len(item[-ANSWER:])
            if cover >= SURE or answer >= 0.5:
                window = numbers[start:end]
                own = np.zeros(len(self.weight) - 1)
                np.add.at(own, item, self.weight[item])
                product = float((own[window[window >= 0]] * self.weight[window[window >= 0]]).sum())
                length = float(np.sqrt(np.square(self.weight[window]).sum()))
                best[t, k] = (product / (length * self.norms[k]), cover, a, b)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", together: int = TOGETHER) -> DataFrame:
    """One row (columns of ``FOUND``) for each document row and benchmark item that it contains.

    The benchmark is read ``together`` items at a time; each such part of it is one pass over the documents.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = benchmark.select(F.col(item_col).cast("long"), F.col("text").cast("string")).toLocalIterator()
    out, sample = None, None
    while part := [tuple(r) for r in islice(rows, together)]:
        query = Query(part)
        if query.vocabulary:
            sample = fit_sample(slim) if sample is None else sample
            found = _search(slim, sample, query)
            out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def _search(docs: DataFrame, sample: DataFrame, query: Query) -> DataFrame:
    counts, n = document_frequencies(docs, query)
    weight = np.log((1 + n) / (1 + counts)) + 0.1
    searches = []
    for items in query.blocks:
        idf = weight[[query.vocabulary[w] for w in items.vocabulary]]
        searches.append(Search(items, idf, float(np.log(1 + n) + 0.1), fit_index(sample, items, idf)))
    shared = docs.sparkSession.sparkContext.broadcast((query, searches))

    def of(batches):
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in FOUND.split(", ")]
        query, searches = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [query.numbers(t) for t in b.column(1).to_pylist()]
            rows = [(ids[place], i, 1.0, 1.0, at, at + n) for place, x in enumerate(texts) for i, n, at in query.runs(x)]
            for block, search in zip(query.maps, searches, strict=True):
                rows += [(ids[place], search.items.ids[k], *r) for place, k, *r in search.find(block[x] for x in texts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(of, FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that contain an item; rows of an id go together. Rows with a null id stay."""
    bad = find_leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["leaked_"], "left_anti")
