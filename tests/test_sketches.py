"""Approximate answers: their error, their plans, and the stored daily sketches."""

import pytest
from pyspark.sql import functions as F

from conftest import spark_rows
from mercato.operators.sketches import LG_K, approximate_percentiles, distinct_sketch, united
from mercato.queries import APPROXIMATE, ask
from mercato.sinks.results import read_tables, write_tables
from mercato.sinks.versions import current, tables_of
from messy_store import spark_store, tables
from test_plans import plan_of


def test_united_sketches_count_each_value_once_within_the_error(spark):
    rows = spark.range(300_000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 30).alias("day"), (F.col("id") % 60_000).alias("v")
    )
    stored = rows.groupBy("g", "day").agg(distinct_sketch(F.col("v")).alias("buyers"), F.count("*").alias("n"))
    found = {r["g"]: r for r in united(stored, ["g"], ["n"], ["buyers"]).collect()}
    error = 1.04 / 2 ** (LG_K / 2)
    for g, r in found.items():
        assert r["n"] == 100_000
        assert abs(r["buyers"] - 20_000) < 4 * error * 20_000
    assert stored.agg(F.max(F.length("buyers"))).first()[0] < 2 ** (LG_K + 1)


def test_sketches_leave_out_nulls_and_may_be_empty(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("b", None), ("b", 1)], "g string, v long")
    stored = rows.groupBy("g").agg(distinct_sketch(F.col("v")).alias("s"))
    assert {tuple(r) for r in united(stored, ["g"], [], ["s"]).collect()} == {("a", 0), ("b", 1)}


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles_are_off_by_their_rank_error_at_most(spark, accuracy):
    n = 200_000
    rows = spark.range(n).select((F.xxhash64("id") % 1_000_000).alias("v")).withColumn("v", F.abs("v"))
    values = sorted(r["v"] for r in rows.collect())
    got = approximate_percentiles(rows, F.col("v"), [1, 25, 50, 90, 99], accuracy=accuracy).first()
    assert (got["rows"], got["present"], got["total"]) == (n, n, sum(values))
    for p in (1, 25, 50, 90, 99):
        value = got[f"p{p}"] // 100
        first, last = sum(v < value for v in values), sum(v <= value for v in values)
        assert first - n / accuracy - 1 <= n * p / 100 <= last + n / accuracy + 1


def test_approximate_percentiles_take_one_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    plan = plan_of(approximate_percentiles(rows, F.col("v"), [50, 90], ["g"]))
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


@pytest.fixture(scope="module")
def rolled_up(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rolled"))
    write_tables(spark_store(spark, tables(6)), folder, rollups=True)
    assert {"product_days", "place_days"} <= set(tables_of(spark, current(spark, folder)))
    return read_tables(spark, folder)


@pytest.mark.parametrize("name", [n for n in APPROXIMATE if n != "b4_ltv_distribution"])
def test_few_customers_are_counted_exactly(spark, rolled_up, name):
    """Also where there is no stored rollup."""
    exact = spark_rows(ask(name, rolled_up))
    assert spark_rows(ask(name, rolled_up, approximate=True)) == exact
    assert spark_rows(ask(name, spark_store(spark, tables(6)), approximate=True)) == exact


@pytest.mark.parametrize("name", [n for n in APPROXIMATE if n != "b4_ltv_distribution"])
def test_stored_sketches_are_all_that_is_read(spark, rolled_up, name):
    plan = plan_of(ask(name, rolled_up, approximate=True))
    assert "Join" not in plan and plan.count("FileScan") == 1
    assert "units:bigint" in plan or "sales:decimal" in plan


def test_only_some_questions_have_an_approximate_form(spark, rolled_up):
    with pytest.raises(ValueError, match="a4_cohort_retention"):
        ask("a4_cohort_retention", rolled_up, approximate=True)
