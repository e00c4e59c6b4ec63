"""Shards with a manifest: whole writes only, lengths beside them."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import shards

SCHEMA = "pid bigint, text string, length int"


def docs(spark, start, end, tasks=3):
    text = F.expr("CASE WHEN pid % 11 = 0 THEN null WHEN pid % 7 = 0 THEN '' ELSE repeat('ab', cast(pid % 5 as int)) END")
    return spark.range(start, end, 1, tasks).withColumnRenamed("id", "pid").select("pid", text.alias("text"), F.lit(3).alias("length"))


def put(df, path, mode="errorifexists", rows=20):
    shards.write_listed_shards(df, path, "pid", F.length("text"), rows, mode)


def seen(spark, path):
    return sorted(shards.read_listed_shards(spark, path, SCHEMA).collect(), key=lambda r: r["pid"])


def test_lengths_come_with_the_shards(spark, tmp_path):
    path, df = str(tmp_path / "out"), docs(spark, 0, 131)
    put(df, path)
    assert seen(spark, path) == df.collect()  # a column named length of its own stays
    lengths = shards.read_shard_lengths(spark, path, "pid")
    assert sorted(map(repr, lengths.collect())) == sorted(map(repr, df.select("pid", F.length("text").cast("long").alias("length")).collect()))
    listed = shards.shard_manifest(spark, path).collect()
    assert max(r["rows"] for r in listed) == 20 and sum(r["rows"] for r in listed) == 131
    assert sum(r["length"] for r in listed) == df.agg(F.sum(F.length("text"))).first()[0]
    for r in listed:
        assert spark.read.parquet(f"{path}/{r['file']}").count() == r["rows"] == spark.read.parquet(f"{path}/{r['lengths']}").count()


def test_modes(spark, tmp_path):
    path = str(tmp_path / "out")
    put(docs(spark, 0, 30), path)
    with pytest.raises(ValueError, match="already"):
        put(docs(spark, 30, 40), path)
    put(docs(spark, 30, 40), path, "append")
    assert [r["pid"] for r in seen(spark, path)] == list(range(40))
    put(docs(spark, 5, 9), path, "overwrite")
    assert [r["pid"] for r in seen(spark, path)] == [5, 6, 7, 8]
    put(docs(spark, 0, 0), path, "overwrite")
    assert seen(spark, path) == [] and shards.read_shard_lengths(spark, path, "pid").count() == 0


def test_a_failed_write_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    put(docs(spark, 0, 30), path)
    broken = docs(spark, 30, 600).withColumn("text", F.expr("IF(pid = 590, raise_error('lost'), text)"))
    with pytest.raises(Exception, match="lost"):
        put(broken, path, "append", rows=5)
    assert [r["pid"] for r in seen(spark, path)] == list(range(30))
    assert shards.read_shard_lengths(spark, path, "pid").count() == 30
    assert shards.shard_manifest(spark, str(tmp_path / "none")).count() == 0
