"""Catalog matching against brute force: LIKE, OR and a lateral top-1."""

import random
import re
from decimal import Decimal

import duckdb
import pytest

from conftest import duck_rows, spark_rows
from mercato.operators import match as match_operator
from mercato.operators.match import LINE, in_catalog, line_matches
from messy_store import duck_store, spark_store, tables
from oracle.tables import BEST, CATALOG_ITEMS

LINES = "sku string, lineitem_name string"
VARIANTS = "sku string, lineitem_name string, product_title string, cost_per_item decimal(12,2)"


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    data = tables(seed)
    con = duckdb.connect()
    duck_store(con, data)
    store = spark_store(spark, data)
    matches = store.line_matches()
    kept = in_catalog(store.order_items(), matches)
    assert spark_rows(kept) == duck_rows(con, CATALOG_ITEMS)

    con.execute(f"CREATE VIEW best AS {BEST}")
    best = matches.select(*LINE, "product_title", "cost_per_item")
    matched = """SELECT * FROM best k WHERE EXISTS (
        SELECT 1 FROM variants v WHERE v.sku = k.sku OR v.lineitem_name = k.lineitem_name
           OR k.lineitem_name LIKE v.product_title || '%')"""
    assert spark_rows(best) == duck_rows(con, matched)


def match(spark, lines, variants):
    variants = [(*v[:3], Decimal(v[3])) for v in variants]
    rows = line_matches(
        spark.createDataFrame(lines, LINES), spark.createDataFrame(variants, VARIANTS)
    ).collect()
    return {
        (r["sku"], r["lineitem_name"]): (r["in_catalog"], r["product_title"], r["cost_per_item"])
        for r in rows
    }


def test_other_sku_beats_no_sku(spark):
    """A known other SKU ranks above a missing one, even with another name."""
    got = match(
        spark,
        [("S1", "Bread - Small")],
        [("S9", "Bread - Big", "Bread", 1), (None, "Bread - Small", "Bread", 2)],
    )
    assert float(got[("S1", "Bread - Small")][2]) == 1


def test_longest_title_wins(spark):
    got = match(
        spark, [(None, "Bread Loaf x")], [(None, "a", "Bread", 1), (None, "b", "Bread Loaf", 2)]
    )
    assert got[(None, "Bread Loaf x")][1] == "Bread Loaf"


def test_exact_name_alone_is_not_in_the_catalog(spark):
    """The catalog view knows SKU and title prefix only."""
    got = match(spark, [(None, "Odd name")], [(None, "Odd name", "Other", 1)])
    assert got[(None, "Odd name")][0] is False


def test_wildcards_in_titles(spark):
    got = match(
        spark,
        [(None, "100 whole Rye"), (None, "MixxA!"), (None, "a\\b c"), (None, "Tip")],
        [(None, "p", "100% Rye", 1), (None, "q", "Mix_A", 2), (None, "r", "a\\b", 3)],
    )
    assert {k[1]: v[1] for k, v in got.items()} == {
        "100 whole Rye": "100% Rye", "MixxA!": "Mix_A", "a\\b c": "a\\b",
    }


def test_a_title_with_many_variants_adds_few_candidates(spark):
    from mercato.operators.match import _variants_by_lookup

    variants = spark.range(5000).selectExpr(
        "concat('S', id) sku", "concat('Bread - ', id) lineitem_name", "'Bread' product_title",
        "cast(1 as decimal(12,2)) cost_per_item",
    )
    assert _variants_by_lookup(variants).filter("kind = 3").count() == 1


def test_unknown_may_rank_like_different(spark):
    """Then the exact name decides, as the other SKU is no better than none."""
    lines = spark.createDataFrame([("S1", "Bread - Small")], LINES)
    variants = spark.createDataFrame(
        [("S9", "Bread - Big", "Bread", Decimal(1)), (None, "Bread - Small", "Bread", Decimal(2))], VARIANTS
    )
    best = line_matches(lines, variants, unknown_is_different=True).first()
    assert float(best["cost_per_item"]) == 2


def spark_like(name, title):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in title)
    return re.match(f"(?s){pattern}", name) is not None


@pytest.mark.parametrize("gram", [1, 2, 4])
def test_early_wildcards_equal_brute_force(spark, monkeypatch, gram):
    monkeypatch.setattr(match_operator, "GRAM", gram)
    pick = random.Random(gram)
    letters = "ab%_ é"
    titles = {"".join(pick.choice(letters) for _ in range(pick.randint(0, 6))) for _ in range(80)}
    titles |= {"%", "_", "%%_", "%bread", "_a%b", "%%zz%", "a", "%\\a"}
    names = {"".join(pick.choice("abé z") for _ in range(pick.randint(0, 9))) for _ in range(150)} | {"x bread y", "\\a"}
    got = match(spark, [(None, n) for n in names], [(None, None, t, 1) for t in titles])
    expected = {n: max((t for t in titles if spark_like(n, t)), key=lambda t: (len(t), t.encode()), default=None) for n in names}
    assert {k[1]: v[1] for k, v in got.items()} == {n: t for n, t in expected.items() if t is not None}


def test_titles_that_begin_with_a_wildcard_meet_few_names(spark):
    """Ten thousand such titles over ten thousand names: a few candidates each, not all pairs."""
    variants = spark.range(10_000).selectExpr(
        "cast(null as string) sku", "cast(null as string) lineitem_name",
        "concat('%Bread No ', substr(md5(cast(id as string)), 1, 8), '%') product_title",
        "cast(1 as decimal(12,2)) cost_per_item",
    )
    lines = spark.range(10_000).selectExpr(
        "cast(null as string) sku", "concat('Rye Bread No ', substr(md5(cast(id as string)), 1, 8), ' / big') lineitem_name"
    )
    found = match_operator._candidates(lines.select(*LINE).distinct(), variants)
    assert found.filter("text = ''").isEmpty()
    assert 10_000 <= found.count() < 60_000
    assert line_matches(lines, variants).filter("in_catalog").count() == 10_000


def test_only_titles_without_literal_text_are_compared_with_every_name(spark):
    variants = spark.createDataFrame(
        [(None, None, t, Decimal(1)) for t in ("%", "__", "%tea%", "_x", "nobody%")], VARIANTS
    )
    lines = spark.createDataFrame([(None, f"n{i}") for i in range(50)], LINES)
    found = match_operator._candidates(lines.select(*LINE).distinct(), variants)
    assert {r["pattern"] for r in found.collect()} == {"(?s)^.*", "(?s)^.."}
