"""Shards whose lengths are written with them: a Spark data source with a manifest."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

LENGTH = "_shard_length"
MANIFEST = "file string, lengths string, rows bigint, length bigint"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (file, lengths, rows, length) of each shard."""

    shards: list[tuple[str, str, int, int]]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _manifests(path: str) -> list[str]:
    system, root = _place(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/_manifests", allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".json"))


class ShardWriter(DataSourceArrowWriter):
    """Each task cuts its rows into Parquet files of at most ``rows`` rows, and writes their keys and
    lengths into a file beside each. File names are new in every attempt; only those a
    manifest lists exist for readers, so a task that fails or runs twice adds no rows."""

    def __init__(self, path: str, key: str, rows: int, overwrite: bool):
        self.path, self.key, self.rows, self.overwrite = path, key, rows, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _place(self.path)
        system.create_dir(f"{root}/data")
        shards, texts, sizes, names, rows, length = [], None, None, None, 0, 0

        def close():
            texts.close()
            sizes.close()
            shards.append((*names, rows, length))

        for whole in iterator:
            start = 0
            while start < whole.num_rows:
                batch = whole.slice(start, self.rows - rows)
                start += batch.num_rows
                kept = batch.drop_columns([LENGTH])
                pair = pa.RecordBatch.from_arrays([batch.column(self.key), batch.column(LENGTH)], names=[self.key, "length"])
                if texts is None:
                    stem = uuid.uuid4().hex
                    names = (f"data/{stem}.parquet", f"data/{stem}.lengths.parquet")
                    texts, sizes = (
                        pq.ParquetWriter(f"{root}/{name}", data.schema, filesystem=system) for name, data in zip(names, (kept, pair))
                    )
                texts.write_batch(kept)
                sizes.write_batch(pair)
                rows += batch.num_rows
                length += pc.sum(batch.column(LENGTH)).as_py() or 0
                if rows == self.rows:
                    close()
                    texts, rows, length = None, 0, 0
        if texts is not None:
            close()
        return Written(shards)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        before = _manifests(self.path)
        system.create_dir(f"{root}/_manifests")
        name = f"{root}/_manifests/{uuid.uuid4().hex}"
        listed = [dict(zip(("file", "lengths", "rows", "length"), s)) for m in messages if m for s in m.shards]
        with system.open_output_stream(f"{name}.part") as out:
            out.write("".join(json.dumps(entry) + "\n" for entry in listed).encode())
        system.move(f"{name}.part", f"{name}.json")  # readers see all of it or nothing
        if self.overwrite:
            for old in before:
                system.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        for message in messages:
            for file, lengths, _, _ in message.shards if message else []:
                system.delete_file(f"{root}/{file}")
                system.delete_file(f"{root}/{lengths}")


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_shards"

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        options = self.options
        return ShardWriter(options["path"], options["key"], int(options["rows"]), overwrite)


def write_listed_shards(
    df: DataFrame, path: str, key: str, length: Column, rows_per_shard: int = 200_000, mode: str = "errorifexists"
) -> None:
    """``df`` in Parquet files of at most ``rows_per_shard`` rows, with the ``length`` of every row in a
    table of its own, written in the same pass and committed together.

    Readers see a whole write or nothing of it. ``mode`` is errorifexists, append or overwrite, which
    replaces what readers see (older files stay until they are removed). Rows without a length
    count as 0 in the totals. ``key`` names a row in the table of lengths. An empty ``df`` commits an empty write.
    """
    if mode == "errorifexists":
        if _manifests(path):
            raise ValueError(f"{path} already holds shards")
        mode = "append"
    df.sparkSession.dataSource.register(ShardSource)
    writer = df.withColumn(LENGTH, length.cast("bigint")).write.format(ShardSource.name()).mode(mode)
    writer.option("key", key).option("rows", rows_per_shard).save(path)


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, lengths, rows, length): a row for each shard of ``path``."""
    found = [posixpath.join(path, "_manifests", posixpath.basename(m)) for m in _manifests(path)]
    return spark.read.schema(MANIFEST).json(found) if found else spark.createDataFrame([], MANIFEST)


def _listed(spark: SparkSession, path: str, column: str, schema: str | StructType) -> DataFrame:
    names = [posixpath.join(path, r[0]) for r in shard_manifest(spark, path).select(column).toLocalIterator()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def read_listed_shards(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return _listed(spark, path, "file", schema)


def read_shard_lengths(spark: SparkSession, path: str, key: str, kind: str = "bigint") -> DataFrame:
    """(key, length) of every row of the shards, without reading the rows."""
    return _listed(spark, path, "lengths", f"`{key}` {kind}, length bigint")
