"""The folder that driver and executors share, and checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A temporary one stands in for it only where all runs on this machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="reportloom-")
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there stays until the folder is cleared."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder; runs a job."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_base(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a name like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list:
    """The columns of ``df`` as they are, whatever marks are in their names."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]
