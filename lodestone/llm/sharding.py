"""Contiguous shards of nearly equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .tables import stored, utf8


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put documents, in order of doc_id, into ``shards`` contiguous shards.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32, shard, slot (place
    in the shard, from 0). Rows are range-partitioned by doc_id without their
    texts, each partition's bytes and rows are totalled, the totals (a row per
    partition) are summed up, and only the rows of one partition are ever
    sorted together. A document belongs to the equal share of all bytes in
    which its middle lies, so a shard is off its target by at most the
    larger of the documents at its ends.

    Null text: no bytes, size 1, checksum 0. Null doc_id sorts first. Rows with
    the same doc_id are ordered by checksum and size; rows that agree in all
    three are told apart by where they were read, so they never gather in one
    task. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.select(
        "doc_id",
        (F.octet_length(utf8("text")).cast("long") + 1).alias("size"),
        F.crc32(utf8("text")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_read"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("_read")]
    # Written once: the borders of a range partitioning are sampled, so it may not be computed twice.
    dealt = stored(sized.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))

    totals = dealt.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everything).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    start = F.sum("size").over(inside) - F.col("size")
    placed = (
        dealt.withColumn("_start", start)
        .withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_part")  # a row for each of ``parts`` partitions
        .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_start")) + F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (_middle * {shards}) div (2 * _all)) as int)"))
        .withColumn("_at", F.col("_rows_before") + F.col("_row"))
    )
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row for each shard
        "doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).alias("slot")
    )
