"""Shards against one sorted list."""

import random
import zlib

from lodestone.llm.sharding import shard_by_bytes


def brute(rows, shards):
    sized = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, before, out, slots = sum(r[1] for r in sized), 0, [], {}
    for doc, size, crc in sized:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((doc, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return sorted(out, key=repr)


def run(spark, rows, shards=16):
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, size int, slot int, _part int")
    return sorted([tuple(r) for r in shard_by_bytes(docs.repartition(5), shards).collect()], key=repr)


def test_against_one_sorted_list(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-50, 200), "é" * rng.randint(0, 400)) for _ in range(300)]
    rows += [(None, None), (None, "x"), (5, None), (7, "y" * 50_000), *[(9, "same")] * 100]
    for shards in (1, 16, 700):
        assert run(spark, rows, shards) == brute(rows, shards)


def test_shards_are_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard_by_bytes(docs).collect()
    total = [0] * 16
    for r in rows:
        total[r["shard"]] += r["size"]
    largest = max(r["size"] for r in rows)
    assert max(abs(t - sum(total) / 16) for t in total) <= largest


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a")]) == brute([(1, "a")], 16)
