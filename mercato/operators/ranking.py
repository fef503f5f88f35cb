"""Global row numbers, running totals and NTILE without a one-task window.

Rows are dealt out by ranges of whole order tuples, tie-breakers included, so a
value shared by a third of the rows is still divided between buckets. Spark
draws the ranges from a sample of a hundred rows for each bucket and finds a
row's bucket by binary search. The number of buckets follows the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from mercato.operators.histogram import count_values, running_totals
from mercato.session import checkpoint

#: There is a bucket for about so many rows.
ROWS_PER_BUCKET = 200_000


@dataclass(frozen=True)
class Key:
    """A sort key; NULLs sort last in both directions."""

    column: str
    descending: bool = False


def _order_tuple(keys: Sequence[Key]) -> Column:
    """One comparable struct per row. Descending keys must be numeric."""
    parts = []
    for i, key in enumerate(keys):
        value = -F.col(key.column) if key.descending else F.col(key.column)
        parts += [F.col(key.column).isNull().alias(f"n{i}"), value.alias(f"v{i}")]
    return F.struct(*parts)


def _literal(row: Row, types: Sequence) -> Column:
    return F.struct(
        *[F.lit(v).cast(t.dataType).alias(t.name) for v, t in zip(row, types, strict=True)]
    )


def _in_buckets(df: DataFrame, order: str, rows: int) -> DataFrame:
    """``df`` dealt out by ranges of ``order``, with ``__bucket``, as stored rows.

    Buckets number the ranges in order, so a bucket's rows precede the next one's.
    """
    buckets = -(-rows // ROWS_PER_BUCKET) + 1
    dealt = df.repartitionByRange(buckets, F.col(order))
    return checkpoint(dealt.withColumn("__bucket", F.spark_partition_id()))


def rank_rows(df: DataFrame, keys: Sequence[Key], sums: Sequence[str] = ()) -> DataFrame:
    """Add ``row_number`` (1-based, global) and ``upto_<s>`` running sums.

    ``keys`` must be unique together. ``df`` is read three times; give it a
    stored table or a checkpoint.
    """
    ordered = df.withColumn("__o", _order_tuple(keys))
    bucketed = _in_buckets(ordered, "__o", df.count())
    within = Window.partitionBy("__bucket").orderBy("__o")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = bucketed.withColumn("__i", F.row_number().over(within).cast("bigint"))
    for s in sums:
        numbered = numbered.withColumn(f"__upto_{s}", F.coalesce(F.sum(s).over(upto), F.lit(0)))
    local = {"row_number": "__i", **{f"upto_{s}": f"__upto_{s}" for s in sums}}

    totals = bucketed.groupBy("__bucket").agg(
        F.count("*").alias("row_number"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"upto_{s}") for s in sums],
    )
    # One row for ROWS_PER_BUCKET rows from here to the broadcast.
    earlier = (
        Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        "__bucket",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__before_{c}") for c in local],
    )
    placed = numbered.join(F.broadcast(offsets), "__bucket")
    return placed.select(
        *df.columns,
        *[(F.col(f"__before_{name}") + F.col(c)).alias(name) for name, c in local.items()],
    )


@dataclass(frozen=True)
class _Edge:
    """The tuple on which a tile ends, and how many of its copies lie before the end."""

    order: Row
    copies_before: int
    copies: int


def _tile_ends(rows: int, tiles: int) -> list[int]:
    size, extra = divmod(rows, tiles)
    return [j * size + min(j, extra) for j in range(1, tiles)]


def _values_at(df: DataFrame, key: Key, ends: Sequence[int]) -> list[Row]:
    """The key's values that hold the ranks ``ends``: value, rows before it and rows with it."""
    counts = count_values(df, F.col(key.column))
    placed = running_totals(counts, ["n"], descending=key.descending)
    inside = [(F.col("before_n") < e) & (F.col("before_n") + F.col("n") >= e) for e in ends]
    found = placed.filter(reduce(lambda a, b: a | b, inside))
    return sorted(found.collect(), key=lambda r: r["before_n"])


def _find_edges(
    df: DataFrame, key: Key, order: Column, ends: Sequence[int]
) -> list[_Edge]:
    """Locate the order tuples at the ranks ``ends``.

    Counts per key value tell which values hold the ranks. Only rows with those
    values are put in order, by ranges, and of these only the ranges that hold a rank
    are sorted.
    """
    if not ends:
        return []
    values = _values_at(df, key, ends)
    here = reduce(lambda a, b: a | b, [F.col(key.column).eqNullSafe(F.lit(r["value"])) for r in values])
    tuples = df.filter(here).groupBy(order.alias("o")).agg(F.count("*").alias("copies"))
    ranged = _in_buckets(tuples, "o", sum(r["n"] for r in values))
    sizes = ranged.groupBy("__bucket").agg(F.sum("copies").alias("n")).orderBy("__bucket").collect()

    # Ranks among the rows at hand, and from there ranks within a bucket.
    targets, skipped = [], 0
    for r in values:
        first = r["before_n"]
        targets += [e - first + skipped for e in ends if first < e <= first + r["n"]]
        skipped += r["n"]
    wanted, before = [], 0
    for size in sizes:
        wanted += [(size["__bucket"], t - before) for t in targets if before < t <= before + size["n"]]
        before += size["n"]
    upto = (
        Window.partitionBy("__bucket")
        .orderBy("o")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    first, last = F.col("upto") - F.col("copies"), F.col("upto")
    hits = F.filter(
        F.array(*[F.struct(F.lit(b).alias("b"), F.lit(t).cast("bigint").alias("t")) for b, t in wanted]),
        lambda w: (w["b"] == F.col("__bucket")) & (w["t"] > first) & (w["t"] <= last),
    )
    found = (
        ranged.filter(F.col("__bucket").isin([b for b, _ in wanted]))
        .withColumn("upto", F.sum("copies").over(upto))
        .select("__bucket", "o", "copies", first.alias("first"), F.explode(hits).alias("hit"))
        .orderBy("__bucket", "hit.t")
        .collect()
    )
    return [_Edge(r["o"], r["hit"]["t"] - r["first"], r["copies"]) for r in found]


def tiled_groups(
    df: DataFrame,
    tiles: int,
    orderings: Mapping[str, Key],
    ties: Sequence[Key],
    by: Sequence[str] = (),
    sums: Sequence[str] = (),
) -> DataFrame:
    """NTILE under each ordering, then rows (``n``) and sums per tile group.

    NTILE needs only the tuples at the tile edges, not a sort of all rows:
    they are found by counts and ranges, and every row is then compared with the
    few edge tuples where it lies. Result: one row per (tile of each ordering, ``by``).

    Rows are ordered by the ordering's key, then ``ties``. ``ties`` must cover
    every column in ``by`` and ``sums``: rows equal on all of them are copies,
    and copies on a tile edge are divided to give exact tile sizes. ``sums``
    are whole numbers and keys bigints. ``df`` is read several times; give it a
    stored table or a checkpoint.
    """
    orders = {name: _order_tuple([key, *ties]) for name, key in orderings.items()}
    some_order = next(iter(orders.values()))
    types = df.select(some_order.alias("o")).schema["o"].dataType.fields
    rows = df.count()
    ends = [e for e in _tile_ends(rows, tiles) if e > 0]
    with ThreadPoolExecutor(len(orderings)) as pool:  # their jobs do not depend on each other
        found = pool.map(lambda name: _find_edges(df, orderings[name], orders[name], ends), orderings)
        edges = dict(zip(orderings, found, strict=True))

    tile_columns, split_columns, divided = [], [], False
    for name, order in orders.items():
        tile = F.lit(1)
        for edge in edges[name]:
            tile = tile + (order > _literal(edge.order, types)).cast("int")
        tile_columns.append(tile.cast("bigint").alias(name))

        splits: dict[Row, list[int]] = {}
        for edge in edges[name]:
            if edge.copies_before < edge.copies:
                splits.setdefault(edge.order, []).append(edge.copies_before)
        at_edge = F.array().cast("array<bigint>")
        for tuple_, positions in splits.items():
            divided = True
            here = F.array(*[F.lit(p).cast("bigint") for p in positions])
            at_edge = F.when(order == _literal(tuple_, types), here).otherwise(at_edge)
        split_columns.append(at_edge.alias(f"__split_{name}"))

    tiled = df.select(*by, *sums, *tile_columns, *(split_columns if divided else []))
    split_names = [f"__split_{name}" for name in orders] if divided else []
    grouped = tiled.groupBy(*orders, *split_names, *by).agg(
        F.count("*").alias("n"),
        *[F.sum(s).alias(s) for s in sums],
        *[F.count(s).alias(f"__has_{s}") for s in sums],
    )
    if divided:
        grouped = _divide_copies(grouped, list(orders), sums)
        grouped = grouped.groupBy(*orders, *by).agg(
            F.sum("n").alias("n"),
            *[F.sum(s).alias(s) for s in sums],
            *[F.sum(f"__has_{s}").alias(f"__has_{s}") for s in sums],
        )
    return grouped.withColumnsRenamed({f"__has_{s}": f"{s}_rows" for s in sums})


def _divide_copies(grouped: DataFrame, names: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Share each group of edge copies between the tiles it straddles.

    Copy ``i`` of a tuple lies in tile ``base + number of split positions
    below i``; cutting at the split positions of all orderings gives runs of
    copies that agree on every tile.
    """
    ends = F.array_sort(
        F.array_distinct(F.concat(*[F.col(f"__split_{n}") for n in names], F.array("n")))
    )
    runs = grouped.withColumn("__ends", ends).select("*", F.posexplode("__ends").alias("__k", "__end"))
    first = F.when(F.col("__k") == 0, F.lit(0)).otherwise(F.get("__ends", F.col("__k") - 1))
    runs = runs.withColumn("__run", F.col("__end") - first)
    for name in names:
        passed = F.size(F.filter(F.col(f"__split_{name}"), lambda p: p < F.col("__end")))
        runs = runs.withColumn(name, F.col(name) + passed)
    for s in sums:
        for c in (s, f"__has_{s}"):
            # Copies are equal, so a group's sum is a whole multiple of its size.
            share = F.expr(f"`{c}` div n") * F.col("__run")
            whole = F.size("__ends") == 1
            runs = runs.withColumn(c, F.when(whole, F.col(c)).otherwise(share).cast("bigint"))
    return runs.withColumn("n", F.col("__run"))
