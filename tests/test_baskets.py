import random
from collections import Counter
from itertools import combinations

import pytest

from mercato.operators import baskets
from mercato.operators.baskets import pair_counts


def brute(rows, least):
    orders = {}
    for order, name in rows:
        orders.setdefault(order, set()).add(name)
    products = Counter(n for names in orders.values() for n in names)
    together = Counter(p for names in orders.values() for p in combinations(sorted(names), 2))
    return {(a, b, n, products[a]) for (a, b), n in together.items() if n >= least}


@pytest.mark.parametrize("block", [256, 4])
@pytest.mark.parametrize("least", [1, 2, 5])
def test_pairs_equal_brute_force(spark, monkeypatch, block, least):
    """Small blocks cut baskets into many lists."""
    monkeypatch.setattr(baskets, "BLOCK", block)
    r = random.Random(block * least)
    rows = {(f"o{r.randrange(60)}", f"p{r.randrange(25):02}") for _ in range(400)}
    for i, size in enumerate((25, 25, 24, 20, 18, 15)):
        rows |= {(f"big{i}", f"p{p:02}") for p in range(size)}
    df = spark.createDataFrame(sorted(rows), "order_name string, lineitem_name string")
    got = {tuple(x) for x in pair_counts(df, least).collect()}
    assert got == brute(rows, least)


def test_largest_baskets_propose_no_pairs(spark, monkeypatch):
    """One basket with most rows adds support but is not paired itself."""
    monkeypatch.setattr(baskets, "BLOCK", 10)
    rows = [("huge", f"p{i:04}") for i in range(500)]
    rows += [("a", "p0001"), ("a", "p0002"), ("b", "p0003"), ("b", "p0500")]
    df = spark.createDataFrame(rows, "order_name string, lineitem_name string")
    assert {tuple(x) for x in pair_counts(df, 2).collect()} == {("p0001", "p0002", 2, 2)}


def test_nothing_together(spark):
    df = spark.createDataFrame([("a", "x")], "order_name string, lineitem_name string")
    assert pair_counts(df, 1).collect() == []


def test_baskets_of_five_thousand_products(spark):
    """Two of them, so that one is paired whole; and rare pairs beside them."""
    rows = [(order, f"p{i:04}") for order in ("big1", "big2") for i in range(0, 5000)]
    rows += [("a", "p0001"), ("a", "p4999"), ("b", "p0001"), ("b", "p4999"), ("c", "q"), ("d", "q")]
    df = spark.createDataFrame(rows, "order_name string, lineitem_name string")
    assert {tuple(x) for x in pair_counts(df, 4).collect()} == {("p0001", "p4999", 4, 4)}
    assert pair_counts(df, 2).count() == 5000 * 4999 // 2
