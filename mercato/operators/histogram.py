"""Ranks, running totals, tiles and percentiles from value counts.

Rows that share a value are interchangeable in a sorted running total, a tile
sum or a percentile. So each operator here first counts rows per value, which
map-side combining makes cheap however many copies a value has, and then works
on the counts.

Values are whole numbers (cents, days, units). To place a value in the global
order the counts are cut into bands of ``2**BAND_BITS`` consecutive values, and
the bands into ranges of ``2**RANGE_BITS`` bands: a running sum in each, plus the
running sums of the totals above. A window thus holds at most ``2**BAND_BITS``
counts, ``2**RANGE_BITS`` bands or, as a bigint has 64 bits, ``2**22`` ranges of a group, whatever
the values and however many rows there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import whole_quotient
from mercato.operators.joins import null_safe_join
from mercato.session import checkpoint

BAND_BITS = 20
RANGE_BITS = 22


def count_values(
    df: DataFrame, value: Column, by: Sequence[str] = (), sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows per (group, value) as ``n``, with further sums carried along."""
    extra = [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    return df.withColumn("value", value).groupBy(*by, "value").agg(F.count("*").alias("n"), *extra)


def _in_order(name: str, descending: bool) -> Column:
    c = F.col(name)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def _with_band(counts: DataFrame, descending: bool = False) -> DataFrame:
    """Add ``band``; NULL values get a band after all others."""
    last = F.lit(-(1 << 62) if descending else 1 << 62)
    return counts.withColumn("band", F.coalesce(F.shiftright("value", BAND_BITS), last))


def _before(measure: str, order: Column, by: Sequence[str]) -> Column:
    # The constant keeps the window partitioned when there are no groups.
    earlier = (
        Window.partitionBy(*by, F.lit(0))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(measure).over(earlier), F.lit(0))


def _join_on(left: DataFrame, right: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    if by:
        return null_safe_join(left, right, [*by, key], "inner")
    return left.join(right, key)


def _placed_bands(
    bands: DataFrame, measures: Sequence[str], totals: Sequence[str], by: Sequence[str], descending: bool = False
) -> DataFrame:
    """Add ``earlier_<m>``, the sum of ``m`` over earlier bands, and ``all_<t>`` over all bands of a group."""
    ranged = bands.withColumn("range", F.shiftright("band", RANGE_BITS))
    ranges = ranged.groupBy(*by, "range").agg(
        *[F.sum(m).alias(f"range_{m}") for m in dict.fromkeys([*measures, *totals])]
    )
    group = Window.partitionBy(*by, F.lit(0))
    ranges = ranges.select(
        *by,
        "range",
        *[_before(f"range_{m}", _in_order("range", descending), by).alias(f"first_{m}") for m in measures],
        *[F.sum(f"range_{t}").over(group).alias(f"all_{t}") for t in totals],
    )
    order = _in_order("band", descending)
    return _join_on(ranged, ranges, by, "range").select(
        *bands.columns,
        *[
            (F.col(f"first_{m}") + _before(m, order, [*by, "range"])).alias(f"earlier_{m}")
            for m in measures
        ],
        *[f"all_{t}" for t in totals],
    )


def running_totals(
    counts: DataFrame, measures: Sequence[str], by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Add ``before_<m>``: the sum of ``m`` over all values sorted earlier.

    NULL values sort last. ``before_n`` is the zero-based rank of the first
    row that has the value.
    """
    cells = _with_band(counts, descending)
    bands = cells.groupBy(*by, "band").agg(*[F.sum(m).alias(m) for m in measures])
    bands = _placed_bands(bands, measures, [], by, descending).select(
        *by, "band", *[f"earlier_{m}" for m in measures]
    )
    order = _in_order("value", descending)
    return _join_on(cells, bands, by, "band").select(
        *counts.columns,
        *[
            (F.col(f"earlier_{m}") + _before(m, order, [*by, "band"])).alias(f"before_{m}")
            for m in measures
        ],
    )


def percentiles(
    counts: DataFrame,
    percents: Sequence[int],
    by: Sequence[str] = (),
    sums: Sequence[str] = (),
) -> DataFrame:
    """Exact interpolated percentiles per group, in hundredths of a value unit.

    Columns: the groups, ``rows`` (all rows), ``total`` (sum of the values),
    ``present`` (rows with a value), each name in ``sums`` added up, and
    ``p<percent>``. Everything is whole-number arithmetic: with ``k`` rows the
    target position is ``(k - 1) * percent / 100``, and the result times 100
    is ``low * 100 + (high - low) * remainder``.

    Band totals show which bands hold the target ranks; only the counts of
    those bands are put in order.
    """
    value, n = F.col("value"), F.col("n")
    if sums:
        # Bands need the sums and cells do not: stored, so that the rows are read once.
        counts = checkpoint(counts)
    counts = counts.withColumn("here", F.when(value.isNotNull(), n).otherwise(0))
    cells = _with_band(counts)
    plain = {"rows": n, "present": F.col("here"), "total": value * n, **{s: F.col(s) for s in sums}}
    bands = cells.groupBy(*by, "band").agg(
        F.sum("here").alias("band_here"), *[F.sum(c).alias(name) for name, c in plain.items()]
    )
    bands = _placed_bands(bands, ["band_here"], list(plain), by).select(
        *by,
        "band",
        "band_here",
        F.col("earlier_band_here").alias("earlier"),
        *[F.col(f"all_{name}").alias(name) for name in plain],
    )

    k = F.col("present")

    def low_rank(p: int) -> Column:
        # Without values the rank is that of no row.
        return F.when(k > 0, whole_quotient((k - 1) * p, F.lit(100)))

    def high_rank(p: int) -> Column:
        return low_rank(p) + F.when(F.pmod((k - 1) * p, F.lit(100)) > 0, 1).otherwise(0)

    def holds(rank: Column, start: Column, rows: Column) -> Column:
        return (start <= rank) & (rank < start + rows)

    wanted = k == 0
    for p in percents:
        for rank in (low_rank(p), high_rank(p)):
            wanted |= holds(rank, F.col("earlier"), F.col("band_here"))
    needed = bands.filter(wanted).drop("band_here")

    placed = _join_on(cells.select(*by, "band", "value", "here"), needed, by, "band").withColumn(
        "start", F.col("earlier") + _before("here", F.col("value").asc(), [*by, "band"])
    )
    ends = []
    for p in percents:
        for name, rank in (("low", low_rank(p)), ("high", high_rank(p))):
            here = holds(rank, F.col("start"), F.col("here"))
            ends.append(F.max(F.when(here, value)).alias(f"{name}_{p}"))
    merged = placed.groupBy(*by).agg(*[F.max(name).alias(name) for name in plain], *ends)
    return merged.select(
        *by,
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce("present", F.lit(0)).cast("bigint").alias("present"),
        "total",
        *sums,
        *[
            (
                F.col(f"low_{p}") * 100
                + (F.col(f"high_{p}") - F.col(f"low_{p}"))
                * F.pmod((F.col("present") - 1) * p, F.lit(100))
            ).alias(f"p{p}")
            for p in percents
        ],
    )


def tile_end(total: Column, tile: int, tiles: int) -> Column:
    """Rows in tiles 1 to ``tile``: the first ``total % tiles`` get one extra."""
    size = whole_quotient(total, F.lit(tiles))
    return tile * size + F.least(F.lit(tile), F.pmod(total, F.lit(tiles)))


def tile_sums(counts: DataFrame, tiles: int, descending: bool = False) -> DataFrame:
    """Rows (``n``) and value sum (``total``) of each of ``tiles`` equal groups.

    A value whose rows straddle a tile edge is shared between the tiles.
    """
    placed = running_totals(counts.select("value", "n"), ["n"], descending=descending)
    all_rows = counts.agg(F.sum("n").alias("rows")).select("rows").scalar()
    first, after = F.col("before_n"), F.col("before_n") + F.col("n")
    parts = []
    for tile in range(1, tiles + 1):
        inside = F.greatest(
            F.lit(0),
            F.least(after, tile_end(all_rows, tile, tiles))
            - F.greatest(first, tile_end(all_rows, tile - 1, tiles)),
        )
        parts.append(F.struct(F.lit(tile).cast("bigint").alias("tile"), inside.alias("n")))
    shared = placed.select("value", F.inline(F.array(*parts))).filter(F.col("n") > 0)
    return shared.groupBy("tile").agg(
        F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("total")
    )


def one_row_each(counted: DataFrame, by: Sequence[str], chunk: int = 100_000) -> DataFrame:
    """Expand each count ``n`` to one row per counted row, numbered from 0 by ``i``.

    Counts are first cut into chunks and the chunks dealt out by hash of
    ``by``, so a count that holds a large share of all rows is expanded by
    many tasks.
    """
    chunks = counted.withColumn(
        "from",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(chunk).cast("bigint"))),
    ).repartition(*by, "from")
    last = F.least(F.col("n"), F.col("from") + chunk) - 1
    return chunks.withColumn("i", F.explode(F.sequence(F.col("from"), last))).drop("from")


def in_chunks(counted: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Counts ``n`` of more than ``chunk`` as several rows, so that expanding one makes at most so many rows."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(chunk).cast("bigint"))
    chunks = counted.withColumn("from", F.explode(starts))
    return chunks.withColumn("n", F.least(F.col("n") - F.col("from"), F.lit(chunk))).drop("from")
