"""Approximate distinct counts and percentiles, where they are asked for.

Both come from sketches of bounded size that merge: one aggregate with map-side combining, or
sketches that are stored per group and day and united when a question is asked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A HyperLogLog sketch has 2**LG_K cells; its relative standard error is about 1.04 / sqrt(2**LG_K).
LG_K = 12
#: Ranks of approximate percentiles are off by at most one in so many rows.
ACCURACY = 10_000


def distinct_sketch(value: Column, lg_k: int = LG_K) -> Column:
    """An aggregate: the sketch of the distinct values, nulls left out."""
    return F.hll_sketch_agg(value, F.lit(lg_k))


def united(rollup: DataFrame, by: Sequence[str], sums: Sequence[str], sketches: Sequence[str]) -> DataFrame:
    """A rollup on fewer columns: its sums added up, and the distinct counts of its sketches."""
    return rollup.groupBy(*by).agg(
        *[F.sum(s).alias(s) for s in sums],
        *[F.hll_sketch_estimate(F.hll_union_agg(F.col(s))).alias(s) for s in sketches],
    )


def approximate_percentiles(
    df: DataFrame,
    value: Column,
    percents: Sequence[int],
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Percentiles per group in one aggregate, in hundredths of a value unit.

    The columns are those of :func:`mercato.operators.histogram.percentiles`. A percentile is a value
    that occurs, and its rank is off by at most ``rows / accuracy``. It is not interpolated. NULL
    values count as rows only.
    """
    found = df.withColumn("value", value).groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count("value").alias("present"),
        F.sum("value").alias("total"),
        *[F.sum(c).alias(name) for name, c in (sums or {}).items()],
        F.percentile_approx("value", [p / 100 for p in percents], accuracy).alias("at"),
    )
    return found.select(
        *[c for c in found.columns if c != "at"],
        *[(F.get("at", F.lit(i)) * 100).alias(f"p{p}") for i, p in enumerate(percents)],
    )
