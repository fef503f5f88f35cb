import random

import pytest
from pyspark.sql import functions as F

from mercato.operators import histogram
from mercato.operators.histogram import (
    count_values,
    one_row_each,
    percentiles,
    running_totals,
    tile_sums,
)


@pytest.fixture(params=[20, 3])
def band_bits(request, monkeypatch):
    """Narrow bands make every path cross band borders."""
    monkeypatch.setattr(histogram, "BAND_BITS", request.param)


def values(seed, n=300):
    r = random.Random(seed)
    return [
        (r.choice(["a", "b", None, "hot", "hot"]), r.choice([None, 0, 7, r.randrange(-50, 400)]))
        for _ in range(n)
    ]


def expected_percentile(xs, p):
    xs = sorted(x for x in xs if x is not None)
    if not xs:
        return None
    whole, rest = divmod((len(xs) - 1) * p, 100)
    high = xs[whole + (rest > 0)]
    return xs[whole] * 100 + (high - xs[whole]) * rest


def test_percentiles_per_group(spark, band_bits):
    rows = [*values(1), ("only null", None), ("single", 5)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    stats = percentiles(
        count_values(df, F.col("v"), ["g"], {"twice": F.col("v") * 2}), [0, 25, 50, 90, 95, 100],
        ["g"], ["twice"],
    )
    got = {r["g"]: r for r in stats.collect()}
    assert set(got) == {g for g, _ in rows}
    for g, r in got.items():
        xs = [v for h, v in rows if h == g]
        known = [x for x in xs if x is not None]
        assert (r["rows"], r["present"]) == (len(xs), len(known))
        assert r["total"] == (sum(known) if known else None)
        assert r["twice"] == (2 * sum(known) if known else None)
        for p in (0, 25, 50, 90, 95, 100):
            assert r[f"p{p}"] == expected_percentile(xs, p), (g, p)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "v bigint")
    row = percentiles(count_values(df, F.col("v")), [50]).collect()
    assert [(r["rows"], r["p50"]) for r in row] == [(0, None)]


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, band_bits, descending):
    xs = [v for _, v in values(2)]
    df = spark.createDataFrame([(x,) for x in xs], "v bigint")
    counts = count_values(df, F.col("v")).withColumn("amount", F.col("value") * F.col("n"))
    rows = running_totals(counts, ["n", "amount"], descending=descending).collect()
    known = sorted((x for x in xs if x is not None), reverse=descending)
    for r in rows:
        if r["value"] is None:
            assert (r["before_n"], r["before_amount"]) == (len(known), sum(known))
        else:
            first = known.index(r["value"])
            assert (r["before_n"], r["before_amount"]) == (first, sum(known[:first]))


@pytest.mark.parametrize("n", [0, 1, 3, 5, 23, 300])
def test_tile_sums(spark, band_bits, n):
    xs = [v for _, v in values(3, n)]
    df = spark.createDataFrame([(x,) for x in xs], "v bigint")
    got = {r["tile"]: (r["n"], r["total"]) for r in tile_sums(count_values(df, F.col("v")), 5, True).collect()}
    ordered = sorted(xs, key=lambda x: (x is None, -(x or 0)))
    size, extra = divmod(n, 5)
    want, at = {}, 0
    for tile in range(1, 6):
        part = ordered[at : at + size + (tile <= extra)]
        at += len(part)
        if part:
            known = [x for x in part if x is not None]
            want[tile] = (len(part), sum(known) if known else None)
    assert got == want


def test_one_row_each_splits_large_counts(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1)], "value string, n bigint")
    each = one_row_each(df, ["value"], chunk=10)
    assert sorted((r["value"], r["i"]) for r in each.collect()) == [
        *[("a", i) for i in range(25)], ("b", 0),
    ]
