"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints of 64 bits are linked when few bits differ. The bits are cut into
partitions so that correlated bits lie together, and every fingerprint gets a
threshold per partition from a dynamic programme over candidate counts. If the
thresholds sum to ``max_bits - partitions + 1``, two linked fingerprints must
lie within the threshold in some partition (-1 skips a partition), whichever of
the two the thresholds belong to. The fingerprint probes the partition's values
within its threshold, and every candidate is verified on all 64 bits.

One more allocation is always open: all 64 bits as a single partition, probed
from both ends. Two fingerprints differ in at most ``max_bits`` bits exactly if
their balls of half that radius meet, so members of a ball key are linked
without any pair being made. Fingerprints that lie in dense neighbourhoods, such
as a group of near copies, cost least this way. The work is thus at most
``ball size`` rows for each distinct fingerprint, whatever the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import per_text, utf8, without
from mercato.llm.components import components
from mercato.session import checkpoint

BITS = 64
#: Shingle hashes are counted in blocks of this many, which bounds memory.
BLOCK = 255 * 256


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one text, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
        count = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        count = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for start in range(0, count, BLOCK):
        size = min(BLOCK, count - start)
        hashes = np.fromiter((digest(s, seed) for s, _ in zip(shingles, range(size))), "<u8", size)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(size, BITS)
        whole = size // 255 * 255
        ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in range(BITS) if 2 * int(ones[i]) > count)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a UTF-8 binary column as bigint; empty texts give 0."""
    run = per_text(
        lambda: lambda t: (fingerprint_of(t, shingle, seed),), {"f": pa.int64()}, "struct<f: bigint>"
    )
    return run(text)["f"]


# --- partitions of correlated bits -------------------------------------------


def _co_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        for start in range(0, len(values), 4096):
            part = np.ascontiguousarray(values[start : start + 4096])
            bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS)
            bits = bits.astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both[i, j])], names=["i", "j", "n"]
    )


def bit_partitions(distinct: DataFrame, total: int, count: int) -> list[list[int]]:
    """``count`` groups of bits; a group takes the bits most correlated with its own.

    Correlations are over all distinct fingerprints; only the 64 x 64 counts
    reach the driver.
    """
    counts = np.zeros((BITS, BITS))
    sums = distinct.select("f").mapInArrow(_co_counts, "i int, j int, n bigint").groupBy("i", "j")
    for row in sums.agg(F.sum("n").alias("n")).collect():
        counts[row.i, row.j] = counts[row.j, row.i] = row.n
    share = np.diag(counts) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    close = np.abs(counts / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    left, groups = list(range(BITS)), []
    for k in range(count):
        size = len(left) // (count - k)
        group = [max(left, key=lambda b: (close[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (close[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def ball(bits: list[int], radius: int) -> list[int]:
    """Masks of at most ``radius`` of the bits, as signed numbers."""
    return [
        _signed(sum(1 << b for b in chosen))
        for r in range(radius + 1)
        for chosen in combinations(bits, r)
    ]


def allocate(counts: np.ndarray, sizes: list[list[float]], spread: list[float], total: int):
    """Thresholds of least cost for each row of ``counts``, and the costs.

    ``counts[r, i]`` is how many fingerprints share row r's value in partition i;
    ``sizes[i][e]`` the values within e bits of one; ``spread[i]`` the expected
    fingerprints of any one value. The cost of threshold e is the probes and the
    estimated candidates. Thresholds sum to ``total``.
    """
    rows, parts = counts.shape
    top = len(sizes[0]) - 1
    low, high = -parts, parts * top
    best = np.full((rows, high - low + 1), np.inf)
    best[:, -low] = 0.0
    picks = []
    for i in range(parts):
        costs = [np.zeros(rows)] + [
            sizes[i][e] + counts[:, i] + (sizes[i][e] - 1) * spread[i] for e in range(top + 1)
        ]
        after = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, np.int8)
        for e, cost in enumerate(costs, start=-1):
            moved = np.full_like(best, np.inf)
            if e < 0:
                moved[:, :-1] = best[:, 1:]
            else:
                moved[:, e:] = best[:, : best.shape[1] - e]
            moved += cost[:, None]
            better = moved < after
            after[better], pick[better] = moved[better], e
        best = after
        picks.append(pick)
    at = np.full(rows, total - low)
    chosen = np.zeros((rows, parts), np.int8)
    line = np.arange(rows)
    cost = best[line, at]
    for i in reversed(range(parts)):
        chosen[:, i] = picks[i][line, at]
        at = at - chosen[:, i]
    return chosen, cost


def _thresholds(sizes, spread, total, whole):
    """An Arrow function: counts per partition to thresholds, null where all bits cost less."""

    @F.arrow_udf("array<int>")
    def run(*columns: pa.Array) -> pa.Array:
        counts = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
        chosen, cost = allocate(counts.astype(float), sizes, spread, total)
        rows = [None if c > whole else r.tolist() for r, c in zip(chosen, cost)]
        return pa.array(rows, pa.list_(pa.int32()))

    return run


# --- links ---------------------------------------------------------------------


def linked(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect fingerprints with at most ``max_bits`` differing bits.

    ``distinct`` has one row for each fingerprint ``f`` and should be stored. Every
    edge is a true link, and any two linked fingerprints are connected by edges.
    """
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be even: the search meets in the middle")
    if max_bits == 0:
        return distinct.select(F.col("f").alias("a"), F.col("f").alias("b")).limit(0)
    total = distinct.count()
    parts = max_bits + 1
    groups = bit_partitions(distinct, total, parts)
    around = ball(list(range(BITS)), max_bits // 2)
    radii = max_bits // 2
    masks = [[ball(g, e) for e in range(radii + 1)] for g in groups]
    sizes = [[float(len(m)) for m in one] for one in masks]
    spread = [total / 2.0 ** len(g) for g in groups]

    values = [
        F.struct(F.lit(i).alias("i"), F.col("f").bitwiseAND(F.lit(masks_of(g))).alias("v"))
        for i, g in enumerate(groups)
    ]
    index = distinct.select("f", F.inline(F.array(*values)))
    tally = checkpoint(index.groupBy("i", "v").agg(F.count("*").alias("n")))
    own = index.join(tally, ["i", "v"]).groupBy("f").agg(
        *[F.max(F.when(F.col("i") == i, F.col("n"))).alias(f"n{i}") for i in range(parts)]
    )
    pick = _thresholds(sizes, spread, max_bits - parts + 1, float(len(around)))
    given = own.select("f", pick(*[F.col(f"n{i}") for i in range(parts)]).alias("t"))

    probes = given.filter(F.col("t").isNotNull()).select(
        "f", F.inline(F.flatten(F.array(*[_signatures(i, values[i], masks[i]) for i in range(parts)])))
    )
    # A neighbouring value may hold more than estimated: such probes go all-bits too.
    real = probes.join(tally, ["i", "v"], "left").groupBy("f").agg(F.sum("n").alias("n"))
    plan = checkpoint(
        given.join(real, "f", "left").select(
            "f", F.when(F.coalesce("n", F.lit(0)) <= len(around), F.col("t")).alias("t")
        )
    )
    light = plan.filter(F.col("t").isNotNull()).select(
        F.col("f").alias("a"),
        F.inline(F.flatten(F.array(*[_signatures(i, values[i], masks[i]) for i in range(parts)]))),
    )
    pairs = (
        light.join(index.select("i", "v", F.col("f").alias("b")), ["i", "v"])
        .filter(F.col("a") != F.col("b"))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )
    dense = plan.filter(F.col("t").isNull()).select(
        "f", F.explode(F.transform(_longs(around), lambda m: F.col("f").bitwiseXOR(m))).alias("key")
    )
    met = dense.select(F.col("f").alias("a"), F.min("f").over(Window.partitionBy("key")).alias("b"))
    return pairs.unionByName(met.filter(F.col("a") != F.col("b")))


def masks_of(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _signatures(i: int, value: Column, masks: list[list[int]]) -> Column:
    """The values that partition i is probed for, as an array of ``(i, v)``."""
    at = F.get(F.col("t"), F.lit(i))
    found = F.array().cast("array<struct<i: int, v: bigint>>")
    for e, within in enumerate(masks):
        near = F.transform(
            _longs(within),
            lambda m: F.struct(F.lit(i).alias("i"), value["v"].bitwiseXOR(m).alias("v")),
        )
        found = F.when(at == e, near).otherwise(found)
    return found


# --- documents ------------------------------------------------------------------


def row_key(text: str, id: str) -> Column:
    """128 bits of a row's id and text."""
    mark = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(mark, F.lit(":"), F.coalesce(F.col(f"`{text}`"), F.lit("")))))


def near_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """Every row's ``(row_key, id, fingerprint, component_id, keep)``.

    ``component_id`` is the smallest id of the documents that links reach, itself
    included. ``keep`` marks one (id, text) of each component, that with the
    smallest id and then key. Null and empty texts have fingerprint zero and are linked like
    any other. Rows with equal id and text are both listed, with the same marks. Null ids
    count only where a component has no other; its id is then null. Other
    columns are left out, so their names cannot clash. An empty table gives no rows. Ids are
    integers, or text that reads as one; other text raises.
    """
    rows = checkpoint(
        docs.select(
            row_key(text, id).alias("row_key"),
            F.col(f"`{id}`").cast("bigint").alias("id"),
            fingerprint(utf8(text), shingle).alias("f"),
        )
    )
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row_key"))
    distinct = checkpoint(rows.groupBy("f").agg(F.min(first).alias("first")))
    roots = checkpoint(components(linked(distinct.select("f"), max_bits)))
    rooted = distinct.join(roots, distinct.f == roots.node, "left").select(
        "f", "first", F.coalesce("root", "f").alias("root")
    )
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    by_print = rooted.join(best, "root").select("f", "best")
    # A second key asks for a fresh shuffle, so a hot fingerprint can be split.
    spread = F.xxhash64("f").alias("s")
    return (
        rows.select("*", spread)
        .join(by_print.select("*", spread), ["f", "s"])
        .select(
            "row_key",
            "id",
            F.col("f").alias("fingerprint"),
            F.col("best.id").alias("component_id"),
            (F.col("row_key") == F.col("best.row_key")).alias("keep"),
        )
    )


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row of each component, with the columns of ``docs``.

    The row with the smallest id stays (then the smallest key of id and text); of
    rows equal in id and text one stays.
    """
    kept = near_duplicates(docs, text, id, shingle, max_bits).filter("keep")
    kept = kept.select(F.col("row_key").alias("__row_key")).distinct()
    keyed = without(docs, "__row_key").withColumn("__row_key", row_key(text, id))
    # Repeated rows go first, and most of them before the shuffle, so that none piles up in the join.
    return keyed.dropDuplicates(["__row_key"]).join(kept, "__row_key").drop("__row_key")


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
