"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# A table may be broadcast up to this many rows and bytes.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 * 1024 * 1024


def small_copy(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local table, or None when it is too large to broadcast.

    A small table is computed only once. Of a larger one, a few rows are fetched
    first; their size bounds how many more may be: at most ``rows + 1``, and
    about BROADCAST_BYTES.
    """
    first = 1024
    fetched = df.limit(min(rows, first) + 1).toArrow()
    if rows > first and fetched.num_rows > first:
        each = max(1, fetched.nbytes // fetched.num_rows)
        rows = min(rows, BROADCAST_BYTES // each)
        if rows <= first:
            return None
        fetched = df.limit(rows + 1).toArrow()
    if fetched.num_rows > rows or fetched.nbytes > BROADCAST_BYTES:
        return None
    if not fetched.num_rows:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.createDataFrame(fetched, df.schema)


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[Column],
    how: str = "inner",
    rows: int = BROADCAST_ROWS,
    salts: int = 64,
) -> DataFrame:
    """Join ``big`` with a lookup table that has few rows per key.

    A small lookup (its size is checked) is broadcast. A larger one is joined as in
    :func:`skewed_join`: only its rows whose key is hot in ``big`` are repeated ``salts`` times, so that the
    rows of one key spread over that many tasks. ``spread_by`` are columns of
    ``big`` that differ between the rows of a key.
    """
    small = small_copy(lookup, rows)
    if small is not None:
        return big.join(F.broadcast(small), on, how)
    joined = skewed_join(big, lookup, on, spread_by, how, salts=salts)
    return joined.select(*on, *[c for c in joined.columns if c not in on])


def weighted_lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    payload: list[str],
    spread_by: list[Column],
    heavy: int = 4096,
    parts: int | None = None,
) -> DataFrame:
    """Left join with a narrow table of unique keys that knows their frequencies.

    The ``heavy`` most frequent keys are broadcast: their number is fixed, and
    for words they serve most rows without a shuffle. Every other key holds
    less than one row in ``heavy``, so the rest is shuffled on the key. Rows
    already served carry a spread number that matches nothing and differs from
    row to row, so they do not pile up. ``parts`` is the number of tasks that join (the session's by default).
    """
    lookup = lookup.filter(F.col(key).isNotNull())  # as the join asks; lets both uses share one exchange
    top = lookup.orderBy(F.col(weight).desc(), F.col(key)).limit(heavy)
    served = top.select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in payload])
    rest = lookup.select(key, F.lit(-1).alias("_spread"), *[F.col(c).alias(f"_cold_{c}") for c in payload])
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(4096)).cast("int")
    marked = big.join(F.broadcast(served), key, "left").withColumn(
        "_spread", F.when(F.col("_hot"), spread).otherwise(F.lit(-1))
    )
    if parts is not None:
        marked, rest = (side.repartition(parts, key, "_spread") for side in (marked, rest))
    joined = marked.join(rest, [key, "_spread"], "left")
    return joined.select(
        *[F.col(c) for c in big.columns],
        *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in payload],
    )


def spread_sides(
    big: DataFrame, right: DataFrame, keys: list[str], spread_by: list[Column], heavy: int, hot_rows: int, salts: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides of :func:`skewed_join` with ``_salt``: the rows of ``big`` dealt out where their
    key is hot, the rows of ``right`` repeated for hot keys only."""
    mark = F.xxhash64(*keys).alias("_mark")
    missing = reduce(or_, [F.col(key).isNull() for key in keys])
    counts = big.filter(~missing).groupBy(mark).agg(F.count("*").alias("_n"))
    hottest = counts.filter(F.col("_n") >= hot_rows).orderBy(F.col("_n").desc(), "_mark").limit(heavy)
    hot = F.broadcast(hottest.select("_mark", F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    spread = F.when(F.col("_hot") | missing, salt).otherwise(F.lit(0))
    everywhere = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = big.withColumn("_mark", mark).join(hot, "_mark", "left").withColumn("_salt", spread)
    repeated = right.withColumn("_mark", mark).join(hot, "_mark", "left")
    return salted, repeated.withColumn("_salt", F.explode(everywhere)).drop("_mark", "_hot")


def skewed_join(
    big: DataFrame,
    right: DataFrame,
    key: str | list[str],
    spread_by: list[Column],
    how: str = "inner",
    heavy: int = 65_536,
    hot_rows: int = 100_000,
    salts: int = 64,
) -> DataFrame:
    """Join ``big`` with a table of few rows per key whose frequencies are unknown.

    The keys of ``big`` are counted first, reading the key columns only. Rows of
    a key with at least ``hot_rows`` rows are spread over ``salts`` tasks, and
    its rows of ``right`` are repeated for them. Only the hashes of the hot
    keys are broadcast, at most ``heavy`` numbers; two keys that share a hash
    are merely both spread. Rows without a key match nothing and are spread too.
    """
    keys = [key] if isinstance(key, str) else key
    salted, repeated = spread_sides(big, right, keys, spread_by, heavy, hot_rows, salts)
    payload = [c for c in right.columns if c not in keys]
    return salted.join(repeated, [*keys, "_salt"], how).select(*big.columns, *payload)


def stored_join(
    big: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: list[Column],
    how: str = "inner",
    heavy: int = 65_536,
    hot_rows: int = 100_000,
) -> DataFrame:
    """As :func:`skewed_join`, with a ``right`` stored in buckets of ``key`` (``storage.bucketed``).

    The rows of ``big`` move to the buckets and ``right`` stays where it is: no exchange on
    its side. Only what meets a key of at least ``hot_rows`` rows, or has no key, goes
    the salted way; the rows of ``right`` with such keys, which are few, are
    picked out by a broadcast of at most ``heavy`` keys.
    """
    counts = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hottest = counts.filter(F.col("_n") >= hot_rows).orderBy(F.col("_n").desc(), key).limit(heavy)
    hot = F.broadcast(hottest.select(key, F.lit(True).alias("_hot")))
    marked = big.join(hot, key, "left")
    apart = F.coalesce("_hot", F.col(key).isNull())
    cold, salted = (marked.filter(side).select(*big.columns) for side in (~apart, apart))
    payload = [c for c in right.columns if c != key]
    met = cold.join(right, key, how).select(*big.columns, *payload)
    return met.unionByName(skewed_join(salted, right.join(hot, key, "left_semi"), key, spread_by, how, heavy, hot_rows))
