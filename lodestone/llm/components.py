"""Connected components of a table of links, by stars that shrink to one node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import stored


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    ``links`` has two columns of whole numbers, in any order and repeated or
    not; null ends and links of a node to itself are ignored. Alternates large
    and small stars: every node's neighbours are hung on the least node among
    them. A node's neighbours are never gathered, only their minimum is; joins
    are on plain keys, so Spark splits the partitions of a hub. Each round is
    written to shared storage. The number of rounds grows with the logarithm
    of the longest path.
    """
    a, b = links.columns
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
            F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
        ).distinct()
    )
    before = None
    for _ in range(most_rounds):
        # large star: each larger neighbour of a node goes to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"components are not stable after {most_rounds} rounds")
