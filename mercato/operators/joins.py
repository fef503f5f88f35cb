"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi join where NULL keys match NULL keys; keeps the left key columns."""
    renamed = right.select(
        *[F.col(f"`{c}`").alias(f"__{c}" if c in on else c) for c in right.columns]
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    joined = left.join(renamed, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__{c}" for c in on])


def spread_join(left: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to one-row-per-key results without letting a hot key pile up.

    ``per_key`` usually comes straight from a ``groupBy(key)``. Spark would
    reuse that partitioning for the join, and adaptive execution only splits a
    skewed partition when both sides are freshly shuffled. Joining on a second
    column derived from the key asks for that fresh shuffle; the aggregated
    side is the small one, so it costs little. Few values do, and take next to no room.
    """
    spread = F.xxhash64(key).bitwiseAND(F.lit(15))
    left = left.withColumn("__spread", spread)
    per_key = per_key.withColumn("__spread", spread)
    return left.join(per_key, [key, "__spread"], how).drop("__spread")
