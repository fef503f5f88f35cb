"""Every question against independent SQL: on a messy store and the sample tables."""

import importlib
import os

import duckdb
import pytest

from conftest import SAMPLE, duck_rows, spark_rows
from mercato.queries import ask, names
from mercato.queries.display import with_headers
from mercato.sources.sample_tables import AS_OF
from messy_store import duck_store, spark_store, tables
from mercato.registry import registered
from mercato.session import shared_folder
from oracle import statements
from oracle.questions import QUESTIONS
from oracle.tables import CTES

entry = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def messy(spark):
    data = tables(seed=7)
    con = duckdb.connect()
    duck_store(con, data)
    for view in ("online_orders", "catalog_items", "best", "buyers"):
        con.execute(f"CREATE VIEW {view} AS {CTES[view]}")
    return spark_store(spark, data), con


@pytest.mark.parametrize("name", names())
def test_messy_store(messy, name):
    store, con = messy
    assert spark_rows(ask(name, store, AS_OF)) == duck_rows(con, QUESTIONS[name])


@pytest.mark.parametrize("name", names())
def test_headers_fit_the_columns(messy, name):
    plain = ask(name, messy[0], AS_OF)
    shown = with_headers(name, plain)
    assert len(set(shown.columns)) == len(plain.columns)
    assert (shown.columns == plain.columns) == name.startswith("r")


@pytest.mark.parametrize("name", names())
def test_empty_store(spark, name):
    """Empty tables give no rows, or the one row of a global aggregate."""
    store = spark_store(spark, {n: [] for n in tables(seed=1)})
    con = duckdb.connect()
    duck_store(con, {n: [] for n in tables(seed=1)})
    for view in ("online_orders", "catalog_items", "best", "buyers"):
        con.execute(f"CREATE VIEW {view} AS {CTES[view]}")
    assert spark_rows(ask(name, store, AS_OF)) == duck_rows(con, QUESTIONS[name])


@pytest.fixture(scope="module")
def sample():
    con = duckdb.connect()
    for file in os.listdir(SAMPLE):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SAMPLE}/{file}'")
    return con


def test_every_query_has_sql():
    assert set(statements()) == set(registered())
    assert set(registered()) <= set(entry.queries())
    assert set(statements()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registered()) - set(names())))
def test_operators_on_sample_tables(spark, sample, name):
    df = registered()[name](spark, SAMPLE)
    assert spark_rows(df) == duck_rows(sample, statements()[name])


def test_no_files_are_left_behind(spark):
    """Queries that write remove what they wrote; checkpoints go with their results."""
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    for name in ("s4_exports_read_back", "k1_stored_tables", "k5_csv_read_back", "k6_session_view"):
        registered()[name](spark, SAMPLE)
    new = set(os.listdir(folder)) - before
    assert not [f for f in new if not f.startswith("rdd-")]


def test_views_of_the_caller_stay(spark):
    spark.range(3).createOrReplaceTempView("customers")
    registered()["s5_catalog_profile"](spark, SAMPLE)
    assert spark.table("customers").columns == ["id"]
    assert [t.name for t in spark.catalog.listTables() if t.name == "orders"] == []
    spark.catalog.dropTempView("customers")


def test_entry_is_cohort_retention(spark, sample):
    expected = duck_rows(sample, entry.oracle_sql()["a4_cohort_retention"])
    assert spark_rows(entry.entry(spark)) == expected
