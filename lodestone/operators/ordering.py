"""Global positions, running aggregates, samples and heads without a global sort.

A plain ``row_number() over (order by ...)`` pulls the whole table into one
task. Everything here works in two levels instead: rows fall into
order-keeping buckets, the buckets are summed (a small table), and only the
rows of one bucket are ever sorted together. The same split keeps a hot key
(one user, one conversation, one run) spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.choice import digest, leading_bits

_FOLD = {"sum": F.sum, "max": F.max}
# Rows without an order value come first, as they do in a sort.
FIRST_BUCKET = -(2**63) + 1


def id_bucket(key: Column, bits: int = 16) -> Column:
    """Order-keeping bucket of an integer key: 2**bits consecutive keys each.

    ``bits`` should grow with the spread of the keys (16 suits dense ids, 44
    suits ids hashed over 64 bits) so that the table of buckets stays small.
    """
    return F.shiftright(key.cast("bigint"), bits)


def range_bucket(df: DataFrame, key: str, buckets: int = 4096) -> Column:
    """Order-keeping bucket of an integer key, as wide as the keys of ``df`` ask
    for: about ``buckets`` of them, whether ids are dense, spread out or hashes.
    The outermost thousandths of the keys share a bucket on either side, so a
    few odd ids don't widen the rest. Reads the key column once."""
    cuts = df.agg(F.percentile_approx(F.col(key).cast("bigint"), [0.001, 0.999], 10_000).alias("c")).first()["c"]
    low, high = cuts or (0, 0)
    bits = ((high - low) // buckets).bit_length()
    inside = F.greatest(F.least(F.col(key).cast("bigint"), F.lit(min(high + 1, 2**63 - 1))), F.lit(max(low - 1, -(2**63))))
    # below and above the cuts: the buckets before the first and after the last
    outside = F.when(F.col(key) < low, -1).when(F.col(key) > high, 1).otherwise(0)
    return F.when(F.col(key).isNotNull(), F.shiftright(inside, bits) + outside)


def prefix_aggregates(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    aggregates: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add, per row, aggregates over all rows strictly before it within ``keys``.

    ``aggregates`` maps a new column to ("sum" | "max", expression). ``bucket``
    must not decrease along ``order``. Sums start at 0, maxima at null.
    """
    rows = df.withColumn("_bucket", F.coalesce(bucket, F.lit(FIRST_BUCKET)))
    totals = rows.groupBy(*keys, "_bucket").agg(
        *[_FOLD[kind](value).alias(f"_total_{name}") for name, (kind, value) in aggregates.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(key).alias(f"_key_{key}") for key in keys],
        F.col("_bucket").alias("_key_bucket"),
        *[
            _FOLD[kind](f"_total_{name}").over(earlier).alias(f"_offset_{name}")
            for name, (kind, _) in aggregates.items()
        ],
    )
    within = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    same = F.col("_bucket") == F.col("_key_bucket")
    for key in keys:  # rows without a key form a group, too
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    joined = rows.join(offsets, same)

    def combined(name, kind, value):
        offset, inside = F.col(f"_offset_{name}"), _FOLD[kind](value).over(within)
        if kind == "sum":
            return F.coalesce(offset, F.lit(0)) + F.coalesce(inside, F.lit(0))
        return F.greatest(offset, inside)

    return joined.select(
        *[F.col(c) for c in df.columns],
        *[combined(name, kind, value).alias(name) for name, (kind, value) in aggregates.items()],
    )


def with_position(
    df: DataFrame, order: list[Column], bucket: Column, keys: list[str] | None = None, name: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row in the given order (within ``keys``)."""
    return prefix_aggregates(df, keys or [], order, bucket, {name: ("sum", F.lit(1).cast("bigint"))})


def seeded_shuffle(df: DataFrame, key: str, seed, epoch: int = 0) -> DataFrame:
    """Add ``position``: the place of each row in a shuffle that depends on
    seed, epoch and the row key only."""
    mark = df.withColumn("_mark", digest(seed, epoch, F.col(key)))
    placed = with_position(mark, [F.col("_mark"), F.col(key)], leading_bits(F.col("_mark"), 4))
    return placed.drop("_mark")


def first_n(df: DataFrame, n: int, order: list[Column], bucket: Column) -> DataFrame:
    """Exactly the first ``n`` rows in an order.

    Buckets are counted from the order columns alone; only rows of buckets that
    begin before the cut are shuffled, which are about ``n`` rows. ``bucket``
    must have a bounded number of values (``range_bucket``, ``leading_bits``):
    their counts are ordered by one task and broadcast.
    """
    rows = df.withColumn("_bucket", F.coalesce(bucket, F.lit(FIRST_BUCKET)))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = counted.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    needed = rows.join(F.broadcast(offsets.filter(F.col("_offset") < n)), "_bucket")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    kept = needed.withColumn("_place", F.col("_offset") + place).filter(F.col("_place") <= n)
    return kept.select(*df.columns)


def sample_n(df: DataFrame, key: str, n: int, seed, epoch: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows if there are fewer)."""
    mark = digest(seed, epoch, F.col(key))
    return first_n(df, n, [mark, F.col(key)], leading_bits(mark, 4))


def head_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by an integer key."""
    return first_n(df, n, [F.col(key)], range_bucket(df, key))


def trailing_mean(placed: DataFrame, keys: list[str], at: str, value: Column, length: int, name: str, bits: int = 16) -> DataFrame:
    """Mean of ``value`` over the current row and the ``length - 1`` rows before it.

    ``placed`` has the position ``at`` of each row within ``keys``; each block of
    positions also receives the last rows of the block before, so blocks can be
    averaged separately.
    """
    block = F.shiftright(F.col(at), bits)
    near_end = F.shiftright(F.col(at) + (length - 1), bits)
    rows = placed.withColumn("_value", value).withColumn("_block", F.explode(F.sequence(block, near_end)))
    frame = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(-(length - 1), 0)
    averaged = rows.withColumn(name, F.avg("_value").over(frame))
    return averaged.filter(F.col("_block") == block).drop("_value", "_block")
