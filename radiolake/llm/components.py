"""Connected components of a link table, by rounds of neighbour minima written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.session import cut_lineage


def _stars(links: DataFrame, inward: bool) -> DataFrame:
    """One round: every node hands its smallest neighbour on to the larger (or, inward, to the smaller) ones."""
    if inward:
        near = links
    else:
        near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = near.join(least, "a")
    handed = met.where(F.col("b") != F.col("m")) if inward else met.where(F.col("b") > F.col("a"))
    out = handed.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    own = least.where(F.col("m") != F.col("a")).select("a", F.col("m").alias("b")) if inward else None
    if own is not None:
        out = out.union(own)
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of a link table ``(a, b)``; the root is the smallest node of its component.

    Alternates large-star and small-star rounds until a round changes nothing,
    which takes about log(nodes) rounds. Every round is written to the shared
    folder, so a lost executor repeats one round at most. Only a count and a checksum
    of the links reach the driver. No links, no rows.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    now = cut_lineage(pairs.distinct(), "links")
    mark = None
    while True:
        now = cut_lineage(_stars(_stars(now, inward=False), inward=True), "links")
        new = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = new
