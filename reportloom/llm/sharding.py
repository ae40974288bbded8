"""Proportional stratified interleaving into shards of equal row counts. Built-in functions only.

Rows of each source are put in a seeded random order; the row at place k of n has the fractional rank (k - 1/2) / n.
Sorted by that rank, every stretch of rows holds the sources in the proportions of the whole, so equal cuts give
shards that match the mixture, with counts at most one apart (law ``rows``).

No source is ever sorted in one task: places are counted in two steps. Rows fall into narrow buckets of the order;
bucket counts are added up over the small table of buckets, and only inside a bucket are rows numbered.

Null sources form a source of their own; null texts count as empty (size 8, CRC 0); null ids are kept and ordered
first. Repeated rows are interchangeable and get places of their own. Extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import checkpointed, shuffle_partitions

#: Rows that a bucket of the order holds on average, at most; and buckets for each shuffle partition, at least.
BUCKET_ROWS, BUCKETS = 10_000, 8


def _places(df: DataFrame, strata: list[Column], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, the place from 1 of each row in its stratum by (bucket, order), without sorting a stratum whole."""
    keys = [f"__s{i}" for i in range(len(strata))]
    df = df.withColumns(dict(zip(keys, strata, strict=True)) | {"__b": bucket})
    counts = df.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    # A two-level running sum keeps even the table of buckets from being sorted in one task.
    group = F.shiftright("__b", 10)
    inner = Window.partitionBy(*keys, "__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__g", group)
    upper = counts.groupBy(*keys, "__g").agg(F.sum("__n").alias("__m")).withColumn("__before_g", F.coalesce(F.sum("__m").over(outer), F.lit(0)))
    counts = counts.withColumn("__in_g", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    before = counts.join(upper, [*keys, "__g"]).select(*keys, "__b", (F.col("__before_g") + F.col("__in_g")).alias("__before"))
    number = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    return df.withColumn("__k", number).join(before, [*keys, "__b"]).withColumn(out, F.col("__before") + F.col("__k")).drop(*keys, "__b", "__before", "__k")


def interleave(df: DataFrame, source: str, id_col: str, ties: list[str], shards: int = 24, seed: int = 42) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard) to the rows of ``df``.

    ``ties`` are the columns that order rows of the same id; rows equal in them too are interchangeable. ``df`` has no
    column whose name begins with two underlines.
    """
    stratum = F.concat(F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce(F.col(source).cast("string"), F.lit("")))
    totals = [tuple(r) for r in df.groupBy(stratum.alias("s")).count().select(F.max("count"), F.sum("count")).collect()][0]
    most, rows = totals[0] or 1, totals[1] or 1
    parts = lambda n: max(1, -(-n // BUCKET_ROWS), min(n, BUCKETS * shuffle_partitions(df.sparkSession)))
    # Rows without an id are told apart by their ties, so that they are no hot bucket.
    unnamed = F.concat_ws(":", F.lit("null"), *[F.col(c).cast("string") for c in ties])
    shuffled = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), unnamed)))).withColumn("__stratum", stratum)
    head = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")
    placed = _places(shuffled, [F.col("__stratum")], F.floor(head * F.lit(parts(most)) / F.lit(1 << 32)).cast("long"), [F.col(c) for c in ("__h", id_col, *ties)], "__place")
    sizes = df.groupBy(stratum.alias("__stratum")).agg(F.count("*").alias("__of"))
    ranked = placed.join(sizes, "__stratum").withColumn("__rank", (F.col("__place") - F.lit(0.5)) / F.col("__of"))
    ordered = _places(ranked, [], F.floor(F.col("__rank") * F.lit(parts(rows))).cast("long"), [F.col(c) for c in ("__rank", "__stratum", "__place")], "__at")
    at = F.col("__at") - 1
    # Shard s holds the places from ceil(s * rows / shards) on: sizes differ by at most one.
    shard = F.expr(f"(__at - 1) * {shards} div {rows}")
    first = F.expr(f"(((__at - 1) * {shards} div {rows}) * {rows} + {shards - 1}) div {shards}")
    return ordered.select(*df.columns, shard.cast("int").alias("shard"), (at - first).cast("long").alias("slot"))


def shard_documents(df: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), source for every row."""
    text = F.coalesce(F.encode(F.col("text"), "utf-8"), F.lit(b""))
    slim = df.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), "source")
    slim = checkpointed(slim)  # ids and digests only: the texts are read once
    done = interleave(slim, "source", "doc_id", ["size", "text_crc32"], shards, seed)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
