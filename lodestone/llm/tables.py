"""Helpers that the operators share: tables on shared storage, Arrow maps, balanced joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import shared_folder, stored  # noqa: F401


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``each`` to the Arrow batches of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from each(batch)

    return df.mapInArrow(run, schema)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null reads as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def hot_keys(df: DataFrame, key: str, share: int = 5_000, least: int = 10_000) -> DataFrame:
    """The keys with at least ``least`` rows and at least one row in ``share``:
    never more than ``share`` of them, whatever the size of ``df``."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*")).first()[0]
    return counts.filter(F.col("_n") >= max(least, total // share)).select(key)


def balanced_lookup(
    df: DataFrame, lookup: DataFrame, key: str, share: int = 5_000, least: int = 10_000, salts: int = 32
) -> DataFrame:
    """Left join with a table of unique keys that stays balanced for hot keys.

    ``lookup`` has one row per key. The rows of a hot key (see ``hot_keys``; at
    most ``share`` of them, so their list may be broadcast) are spread over
    ``salts`` tasks and its one lookup row is repeated for them.
    """
    hot = F.broadcast(hot_keys(df, key, share, least).withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    left = df.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.drop("_hot").join(right, [key, "_salt"], "left").drop("_salt")


def utf8(column: Column | str) -> Column:
    """A text as UTF-8 bytes; null reads as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit("")).cast("binary")
