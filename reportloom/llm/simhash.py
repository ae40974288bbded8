"""SimHash near-duplicate detection with bit-sliced comparison.

A fingerprint has 64 bits over the word shingles of a text. Fingerprints at a distance of at most 3 agree on at
least one of four 16-bit blocks, or on two of five blocks and so on; every choice of blocks is one table, and
only fingerprints that agree on a table's blocks are compared. Inside such a bucket the comparison is bit-sliced:
plane b holds bit b of all fingerprints as packed words, and XORed planes go into carry-save counters, so that 64
distances move at a time; a block is abandoned once every distance in it exceeds the radius.

Only distinct fingerprints are compared, and each task gives a spanning forest of its links, so groups of copies
never expand into pairs. Very large buckets are dealt out as pairs of chunks.

Null texts count as empty; texts without words have fingerprint zero and link like any other. Rows with a null id
get a fingerprint and the least id of their component. Repeated rows stay repeated. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.common import checkpointed, fresh, key_runs, own_columns, shuffle_partitions
from reportloom.llm.components import connected_components

SEED, WIDTH, RADIUS = 42, 3, 3
#: Rows of a bucket that are compared in one task; larger buckets are dealt out as pairs of chunks.
CHUNK = 8192
#: Runs up to this length are compared together, by shifting the planes; longer ones row against block.
SHORT = 48
#: Words of a block of comparisons.
WORDS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64-bit SimHash; a bit is 1 if it is set in over half the shingle hashes, repeats included."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and the six ASCII white spaces
    if not words:
        return 0
    xx = xxhash.xxh64_intdigest
    if len(words) < width:
        return xx(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    hashes = np.array([xx(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""

    def of(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, fp long")


def plane_masks(n: int, blocks: int | None = None, radius: int = RADIUS) -> list[int]:
    """Bit masks of the tables. Any number of blocks over the radius loses no link; more blocks give longer keys.

    By default so many that evenly spread fingerprints leave a few hundred in a bucket.
    """
    if blocks is None:
        blocks = radius + 1
        while n >> (64 * (blocks - radius) // blocks) > 256 and blocks < radius + 5:
            blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def within_radius(planes, radius: int, far: np.ndarray) -> np.ndarray:
    """Packed bits, 1 where the column of bits in ``planes`` (an iterable of word arrays) has at most ``radius`` ones.

    Columns with a bit in ``far`` are none that matter. ``ones`` and ``twos`` are the carry-save counters modulo 4; ``over``
    remembers those that reached ``radius + 1``. Once all are over, no further plane is read.
    """
    if radius != 3:
        raise ValueError("the counters hold a radius of 3")
    over = far.copy()
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    for k, x in enumerate(planes):
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if k % 4 == 3 and (over == FULL).all():
            break
    return ~over


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of row i is bit i % 64 of word i // 64 of plane b. Padded with zeros."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    words = np.zeros((64, -(-len(fps) // 64) * 8), np.uint8)
    words[:, : -(-len(fps) // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return words.view(np.uint64)


def _positions(packed: np.ndarray) -> np.ndarray:
    return np.nonzero(np.unpackbits(np.ascontiguousarray(packed).view(np.uint8), bitorder="little"))[0]


def _packed_bits(flags: np.ndarray, words: int) -> np.ndarray:
    """Flags as the bits of so many words; bits beyond them are 1."""
    bits = np.ones(64 * words, np.uint8)
    bits[: len(flags)] = flags
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _varying(planes: np.ndarray, n: int) -> list[int]:
    """The planes whose first ``n`` bits are not all equal; the others make no difference."""
    whole = ~_packed_bits(np.zeros(n, np.uint8), planes.shape[1])
    return [b for b in range(64) if (planes[b] & whole).any() and ((planes[b] & whole) != whole).any()]


def _links_by_shift(fps: np.ndarray, keys: np.ndarray, longest: int):
    """Links inside runs of equal keys no longer than ``longest``; row i is compared with row i + d for each shift d.

    A block of ``WORDS`` words is given up once all of its pairs are too far apart; pairs of different keys count as that.
    """
    planes, n = _planes(fps), len(fps)
    for d in range(1, min(longest, 64, n)):
        far = _packed_bits(keys[:-d] != keys[d:], planes.shape[1])
        for w in np.nonzero(np.logical_or.reduceat(far != FULL, np.arange(0, len(far), WORDS)))[0] * WORDS:
            at = slice(w, w + WORDS)
            here, next_ = planes[:, at], planes[:, w + 1 : w + WORDS + 1]
            behind = np.zeros_like(here)
            behind[:, : next_.shape[1]] = next_
            i = 64 * w + _positions(within_radius((here[b] ^ (here[b] >> np.uint64(d) | behind[b] << np.uint64(64 - d)) for b in range(64)), RADIUS, far[at]))
            yield fps[i], fps[i + d]


def _links_of_run(fps: np.ndarray, rows: int = 128):
    """Links of one long run: each row against the rows behind it, in blocks of ``WORDS`` words of 64 rows.

    A block is given up once all of its pairs are too far apart. Only a spanning forest of the links is given.
    """
    planes, n = _planes(fps), len(fps)
    order, words = _varying(planes, n), planes.shape[1]
    ends = _packed_bits(np.zeros(n, np.uint8), words)  # what is behind the last row is far
    root = np.arange(n)
    for at in range(0, n, rows):
        own = fps[at : at + rows]
        flips = {b: np.where((own >> np.uint64(b)) & np.uint64(1), FULL, np.uint64(0))[:, None] for b in order}
        for w in range(at // 64, words, WORDS):
            end = min(w + WORDS, words)
            # Bits of rows up to the row itself are far.
            done = np.clip(np.arange(at, at + len(own))[:, None] + 1 - 64 * np.arange(w, end)[None], 0, 64).astype(np.uint64)
            far = np.where(done == 64, FULL, (np.uint64(1) << (done & np.uint64(63))) - np.uint64(1)) | ends[None, w:end]
            near = within_radius((planes[b][None, w:end] ^ flips[b] for b in order), RADIUS, far)
            for k in np.nonzero(near.any(1))[0]:
                i = at + int(k)
                heads = np.unique(root[np.append(64 * w + _positions(near[k]), i)])
                if len(heads) > 1:
                    root[np.isin(root, heads)] = heads[0]
                    yield fps[heads[1:]], np.repeat(fps[heads[:1]], len(heads) - 1)


def _compare(batches):
    """Links among rows (key, fp) that are sorted by key; runs never straddle the tables of ``key_runs``."""
    for t in key_runs(batches, "key"):
        keys, fps = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        short = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
        found = []
        if short.any():
            found += _links_by_shift(fps[short], keys[short], int(sizes[(sizes > 1) & (sizes <= SHORT)].max()))
        for at, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            found += _links_of_run(np.unique(fps[at : at + size]))
        for a, b in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])


def links(distinct: DataFrame, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(src, dst): links among the distinct fingerprints of column ``fp`` that have the components of all links."""
    masks = plane_masks(distinct.count(), blocks)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for t, m in enumerate(masks)])).alias("k")).select("fp", F.xxhash64("k.t", "k.part").alias("bucket"))
    large = keyed.groupBy("bucket").count().where(F.col("count") > chunk).select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("c"))
    dealt = keyed.join(large, "bucket", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("c")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.xxhash64("bucket", F.least(own, j), F.greatest(own, j)))
    tasks = dealt.select("fp", F.explode(pairs).alias("key"))
    n = shuffle_partitions(distinct.sparkSession)
    return tasks.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_compare, "src long, dst long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; the component is the smallest doc_id reachable by links."""
    own = checkpointed(fingerprints(df, id_col, text_col))
    distinct = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = checkpointed(rooted.join(heads, "root").select("fp", "component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(members, "fp").select("doc_id", digits, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component, one row for each such id.

    Rows with a null id cannot stand for a component or be named by one; they all stay.
    """
    rows, head = fresh(docs, "rows_"), fresh(docs, "head_")
    heads = near_duplicates(docs).where("doc_id = component_id").groupBy(F.col("doc_id").alias(head)).agg(F.count("*").alias(rows))
    found = docs.join(checkpointed(heads), docs["doc_id"] == F.col(head))
    repeated = found.where(F.col(rows) > 1).dropDuplicates(["doc_id"])
    own = own_columns(docs)
    return found.where(F.col(rows) == 1).select(*own).union(repeated.select(*own)).union(docs.where("doc_id is null").select(*own))
