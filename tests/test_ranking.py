import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mercato.operators import ranking
from mercato.operators.ranking import Key, rank_rows, tiled_groups


@pytest.fixture(params=[200_000, 20])
def bucket_rows(request, monkeypatch):
    """Small buckets force sampled cut points even on small data."""
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", request.param)


def test_rank_rows(spark, bucket_rows):
    r = random.Random(4)
    rows = [(i, f"n{i:04}", r.choice([None, 7, 7, 7, r.randrange(100)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, name string, v bigint")
    for descending in (True, False):
        got = rank_rows(df, [Key("v", descending), Key("name")], ["v"]).collect()
        ordered = sorted(
            rows, key=lambda x: (x[2] is None, (-1 if descending else 1) * (x[2] or 0), x[1])
        )
        total, want = 0, []
        for n, (i, _, v) in enumerate(ordered, 1):
            total += v or 0
            want.append((i, n, total))
        assert sorted((x["id"], x["row_number"], x["upto_v"]) for x in got) == sorted(want)


def test_a_shared_value_is_divided_between_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 100)
    df = spark.range(2000).select("id", F.lit(1).alias("v"))
    ordered = df.withColumn("o", ranking._order_tuple([Key("v"), Key("id")]))
    bucketed = ranking._in_buckets(ordered, "o", 2000)
    sizes = [r["count"] for r in bucketed.groupBy("__bucket").count().collect()]
    ends = bucketed.groupBy("__bucket").agg(F.min("id"), F.max("id")).orderBy("__bucket").collect()
    assert [r[1] for r in ends[1:]] == [r[2] + 1 for r in ends[:-1]]
    assert len(sizes) >= 20 and max(sizes) < 300


def tile_of(n, tiles):
    size, extra = divmod(n, tiles)
    return [t for t in range(1, tiles + 1) for _ in range(size + (t <= extra))]


@pytest.mark.parametrize("n, kinds", [(0, 1), (3, 9), (7, 2), (250, 3), (250, 40), (251, 1)])
def test_tiled_groups_with_copies(spark, bucket_rows, n, kinds):
    """Copies on a tile edge are shared out so that tile sizes are exact."""
    r = random.Random(n + kinds)
    pool = [
        (f"e{i}", r.choice([None, 1, 2, 9]), r.choice([None, 5, 100 * i])) for i in range(kinds)
    ]
    rows = [r.choice(pool) for _ in range(n)]
    df = spark.createDataFrame(rows, "email string, f bigint, m bigint")
    groups = tiled_groups(
        df, 5, {"a": Key("f", descending=True), "b": Key("m")},
        ties=[Key("email"), Key("f"), Key("m")], by=["email"], sums=["m"],
    )

    def nulls_last(v, sign=1):
        return (v is None, sign * (v or 0))

    def tie(x):
        return (x[0], nulls_last(x[1]), nulls_last(x[2]))

    indexed = [(x, i) for i, x in enumerate(sorted(rows, key=tie))]
    tile_a, tile_b = {}, {}
    for found, key in (
        (tile_a, lambda x: (nulls_last(x[0][1], -1), tie(x[0]), x[1])),
        (tile_b, lambda x: (nulls_last(x[0][2]), tie(x[0]), x[1])),
    ):
        for tile, (_, i) in zip(tile_of(n, 5), sorted(indexed, key=key), strict=True):
            found[i] = tile
    count, total, known = Counter(), Counter(), Counter()
    for x, i in indexed:
        k = (tile_a[i], tile_b[i], x[0])
        count[k] += 1
        total[k] += x[2] or 0
        known[k] += x[2] is not None
    got = {
        (g["a"], g["b"], g["email"]): (g["n"], g["m"] or 0, g["m_rows"]) for g in groups.collect()
    }
    assert got == {k: (count[k], total[k], known[k]) for k in count}


def test_sums_of_very_many_copies_are_exact(spark):
    """A group's sum beyond 2^53 is shared out to the cent."""
    copies, amount = 9_099_074, 16_603_952_838
    df = spark.range(copies, numPartitions=8).select(
        F.lit("e").alias("email"), F.lit(1).cast("bigint").alias("f"), F.lit(amount).alias("m")
    )
    groups = tiled_groups(df, 5, {"a": Key("f")}, ties=[Key("email"), Key("m")], by=["email"], sums=["m"])
    got = {g["a"]: (g["n"], g["m"]) for g in groups.collect()}
    assert sum(n for n, _ in got.values()) == copies
    assert all(m == n * amount for n, m in got.values())


def test_many_buckets_cost_little_more_than_a_shuffle(spark, monkeypatch):
    """Two million rows in 512 buckets: a row's bucket is found by binary search."""
    import time

    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 2_000_000 // 511)
    df = spark.range(2_000_000, numPartitions=8).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    ordered = df.withColumn("o", ranking._order_tuple([Key("v"), Key("id")]))
    start = time.perf_counter()
    bucketed = ranking._in_buckets(ordered, "o", 2_000_000)
    assert bucketed.select("__bucket").distinct().count() > 500
    assert time.perf_counter() - start < 60
