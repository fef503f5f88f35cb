"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.session import checkpoint


def _stamp(edges: DataFrame) -> tuple:
    """Tells whether two edge sets are equal, in one row."""
    return tuple(
        edges.agg(
            F.count("*"),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)),
            F.coalesce(F.bit_xor(F.xxhash64("b", "a")), F.lit(0)),
        ).first()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list of bigints.

    ``root`` is the smallest node reachable. Alternates the large-star and
    small-star steps: each links a node to the smallest neighbour, so the edge
    list never grows beyond its first size and becomes a star per component
    after a logarithmic number of rounds. Each step joins edges with one row per node,
    which adaptive execution can split at a hot node, and each round is cut by
    ``checkpoint()``. Null ends, loops and repeated edges are ignored; no edges
    give no rows.
    """
    ends = edges.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y"))
    now = checkpoint(
        ends.filter(F.col("x") != F.col("y"))
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
    )
    stamp = _stamp(now)
    while stamp[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m"))
        large = now.join(least, now.b == least.u).select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, large.a == low.u).filter(F.col("b") != F.col("m"))
        after = checkpoint(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        before, stamp, now = stamp, _stamp(after), after
        if stamp == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
