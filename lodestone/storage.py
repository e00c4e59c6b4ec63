"""Tables on storage that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local session that names none
    (as in tests) uses one in the machine's temporary folder; on a cluster that
    is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")


def shared_folder(spark: SparkSession, name: str = "table") -> str:
    """A fresh folder under the checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to shared storage and read back: computed once, and its
    lineage is cut, so a lost executor costs one read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int = 256, name: str | None = None) -> DataFrame:
    """``df`` as a table in ``buckets`` buckets of ``key``, sorted by it within.

    Joins on ``key`` (``joins.stored_join``) then move the other side only. The table lies
    under the checkpoint folder, in a file a bucket, and is listed in the session's catalogue as
    ``name`` (a fresh one by default), so that later jobs can read it as ``spark.table(name)``.
    A bucket holds about a ``buckets``-th of the keys: choose as many as keep one within a task.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    spread = df.repartition(buckets, F.col(key))  # each task writes one bucket
    writer = spread.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", shared_folder(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)
