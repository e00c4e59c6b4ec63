import hashlib
import random

from pyspark.sql import functions as F

from lodestone.functions.choice import fill, pick
from lodestone.operators import joins, ordering, runlog


def test_prefix_aggregates_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.5 else rng.randint(2, 9), i, rng.random()) for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i bigint, v double").repartition(7)
    out = ordering.prefix_aggregates(
        df, ["k"], [F.col("i")], ordering.id_bucket(F.col("i"), 3),
        {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))},
    )
    seen = {}
    want = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        past = seen.setdefault(k, [])
        want[i] = (sum(past), max(past, default=None))
        past.append(v)
    got = {r["i"]: (r["s"], r["m"]) for r in out.collect()}
    assert got.keys() == want.keys()
    for i, (s, m) in want.items():
        assert abs(got[i][0] - s) < 1e-9 and got[i][1] == m


def test_rows_without_key_or_order_are_kept(spark):
    rows = [(None, 1, 2.0), (None, 2, 3.0), ("a", None, 5.0), ("a", 7, 1.0)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    out = ordering.prefix_aggregates(
        df, ["k"], [F.col("i")], ordering.id_bucket(F.col("i"), 0), {"s": ("sum", F.col("v"))}
    )
    got = {(r["k"], r["i"]): r["s"] for r in out.collect()}
    assert got == {(None, 1): 0, (None, 2): 2.0, ("a", None): 0, ("a", 7): 5.0}


def test_sample_is_exact_and_stable(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    first = {r["k"] for r in ordering.sample_n(df, "k", 120, 7).collect()}
    again = {r["k"] for r in ordering.sample_n(df.repartition(5), "k", 120, 7).collect()}
    other = {r["k"] for r in ordering.sample_n(df, "k", 120, 8).collect()}
    assert len(first) == 120 and first == again and first != other
    marks = sorted(range(500), key=lambda k: hashlib.md5(f"7:0:{k}".encode()).hexdigest())
    assert first == set(marks[:120])
    assert ordering.sample_n(df, "k", 10_000, 7).count() == 500


def test_head(spark):
    df = spark.createDataFrame([(k * 37 - 900,) for k in range(100)], "k bigint")
    got = sorted(r["k"] for r in ordering.head_n(df, "k", 31).collect())
    assert got == [k * 37 - 900 for k in range(31)]


def test_buckets_fit_the_keys(spark):
    """Few buckets, in the order of the keys, whether ids are dense, hashed or have odd ones."""
    import pyspark.sql.functions as F

    dense = spark.range(50_000).withColumnRenamed("id", "k")
    hashed = spark.range(50_000).select(F.xxhash64("id").alias("k"))
    odd = dense.unionByName(spark.createDataFrame([(2**63 - 1,), (-(2**63),), (None,)], "k long"))
    for df in (dense, hashed, odd):
        rows = df.select("k", ordering.range_bucket(df, "k").alias("b")).filter("k is not null").collect()
        sizes = {}
        for r in rows:
            sizes[r["b"]] = sizes.get(r["b"], 0) + 1
        assert len(sizes) <= 10_000 and max(sizes.values()) <= 200
        in_order = [r["b"] for r in sorted(rows, key=lambda r: r["k"])]
        assert in_order == sorted(in_order)
        assert sorted(r["k"] for r in ordering.head_n(df.filter("k is not null"), "k", 500).collect()) == sorted(r["k"] for r in rows)[:500]


def test_shuffle_differs_by_epoch(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    orders = []
    for epoch in (0, 1):
        rows = ordering.seeded_shuffle(df, "k", 1, epoch).collect()
        orders.append([r["k"] for r in sorted(rows, key=lambda r: r["position"])])
        assert sorted(r["position"] for r in rows) == list(range(50))
    assert orders[0] != orders[1]


def test_pick_and_fill(spark):
    df = spark.range(2000)
    used = df.select(pick(["a {x}", "b {x}", "c {x}"], "s", F.col("id")).alias("t"))
    counts = {r["t"]: r["count"] for r in used.groupBy("t").count().collect()}
    assert len(counts) == 3 and min(counts.values()) > 550
    row = spark.range(1).select(fill(F.lit("{x}-{y}"), x=F.lit("{z}"), y=F.lit("$1\\"))).first()
    assert row[0] == "{z}-$1\\"


def test_joins_agree_with_a_plain_join(spark):
    rng = random.Random(2)
    keys = ["hot"] * 300 + [f"k{rng.randint(0, 80)}" for _ in range(300)] + [None] * 5
    big = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i bigint, key string").repartition(4)
    right = spark.createDataFrame([(f"k{j}", j, 81 - j) for j in range(60)] + [("hot", 99, 500)], "key string, v int, n int")
    for how in ("inner", "left"):
        plain = big.join(right.select("key", "v"), "key", how).select("i", "key", "v")
        skewed = joins.skewed_join(big, right.select("key", "v"), "key", [F.col("i")], how, heavy=2, hot_rows=9, salts=5)
        assert plain.exceptAll(skewed).count() == 0 and plain.count() == skewed.count()
        for rows in (1000, 1):  # broadcast, and salted
            looked = joins.lookup_join(big, right.select("key", "v"), ["key"], [F.col("i")], how, rows, salts=4)
            assert plain.exceptAll(looked.select("i", "key", "v")).count() == 0 and looked.count() == plain.count()
    weighted = joins.weighted_lookup_join(big, right, "key", "n", ["v"], [F.col("i")], heavy=3)
    plain = big.join(right.select("key", "v"), "key", "left").select("i", "key", "v")
    assert plain.exceptAll(weighted).count() == 0 and weighted.count() == plain.count()


def test_a_large_lookup_is_repeated_for_hot_keys_only(spark):
    keys = ["hot"] * 300 + [f"k{i % 60}" for i in range(300)] + [None] * 5
    big = spark.createDataFrame([(i, k, i % 2) for i, k in enumerate(keys)], "i bigint, key string, half int")
    right = spark.createDataFrame([(f"k{j}", j % 2, j) for j in range(60)] + [("hot", 0, 99), ("hot", 1, 98)], "key string, half int, v int")
    salted, repeated = joins.spread_sides(big, right, ["key", "half"], [F.col("i")], heavy=9, hot_rows=100, salts=64)
    assert repeated.count() == 60 + 2 * 64 and salted.count() == big.count()
    assert salted.filter("key = 'hot'").select("_salt").distinct().count() > 30
    for how in ("inner", "left"):
        plain = big.join(right, ["key", "half"], how).select("i", "key", "half", "v")
        for looked in (
            joins.skewed_join(big, right, ["key", "half"], [F.col("i")], how, heavy=9, hot_rows=100),
            joins.lookup_join(big, right, ["key", "half"], [F.col("i")], how, rows=1),
        ):
            assert looked.count() == plain.count() and plain.exceptAll(looked.select(plain.columns)).count() == 0


def test_trailing_mean_crosses_blocks(spark):
    rows = [(0, i * 3, float(i * i % 17)) for i in range(40)] + [(1, 5, 2.0)]
    df = spark.createDataFrame(rows, "run int, step bigint, loss double")
    out = runlog.rolling_loss(df, "run", "step", "loss", 6, bits=2).collect()
    values = [r[2] for r in rows[:40]]
    assert len(out) == 41
    for r in out:
        if r["run"] == 0:
            at = r["step"] // 3
            near = values[max(0, at - 5) : at + 1]
            assert abs(r["window_loss"] - sum(near) / len(near)) < 1e-9
            assert abs(r["rolling_loss"] - sum(values[: at + 1]) / (at + 1)) < 1e-9


def test_best_checkpoint_is_the_first_best(spark):
    rows = [(0, 1, 0.3), (0, 2, 0.5), (0, 3, 0.5), (0, 4, 0.4)]
    df = spark.createDataFrame(rows, "run int, step bigint, metric double")
    out = {r["step"]: r for r in runlog.best_so_far(df, "run", "step", "metric", bits=1).collect()}
    assert [out[s]["improved"] for s in (1, 2, 3, 4)] == [True, True, False, False]
    assert [out[s]["best"] for s in (1, 2, 3, 4)] == [0.3, 0.5, 0.5, 0.5]
    assert runlog.best_checkpoint(df, "run", "step", "metric").first()["step"] == 2
