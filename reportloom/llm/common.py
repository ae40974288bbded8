"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions.shared import checkpointed, fresh, own_columns, shared_folder  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder and read again: worked out once, its lineage cut; runs a job."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no table boundary falls inside a run of equal ``key`` values.

    A table has about ``rows`` rows, more only if one run is longer.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(key).to_numpy()
        last = int((keys != keys[-1]).nonzero()[0][-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield whole.slice(0, last)
        rest = whole.slice(last)
        held, n = rest.to_batches(), rest.num_rows if last else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def md5_bucket(column, digits: int):
    """An integer from the first hex digits of a column's MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(column), 1, digits), 16, 10).cast("long")


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, parts: int) -> DataFrame:
    """Inner join in which no key's rows meet in one task; nulls equal nulls. Runs a job that counts.

    ``right`` has one row for each key and says in ``count`` how many rows of ``left`` have it. Keys with more than a
    ``parts``-th of all rows are at most ``parts`` in number, so they are broadcast; all others are shuffled. ``right``
    is used twice; ``count`` is left out of the result.
    """
    names = [fresh(right, f"{k}_") for k in keys]
    own = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in right.columns if c not in keys])
    total = right.agg(F.sum(count)).first()[0] or 0
    many = F.col(count) * parts > F.lit(total)
    same = lambda r: [left[k].eqNullSafe(r[n]) for k, n in zip(keys, names, strict=True)]
    hot, rest = F.broadcast(own.where(many)), own.where(~many)
    dropped = [*names, count]
    first = left.join(hot, same(hot)).drop(*dropped)
    second = left.join(F.broadcast(hot.select(*names)), same(hot), "left_anti").join(rest, same(rest)).drop(*dropped)
    return first.union(second)
