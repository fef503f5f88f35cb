import re

import pytest

from mercato.sinks.results import read_tables, write_tables
from messy_store import spark_store, tables
from mercato.sources.catalog import (
    catalog_profile,
    load_summary,
    register_views,
    table_preview,
    user_database,
)
from mercato.sources.exports import find_exports, headers_of, kind_of, load_exports, read_export

CUSTOMERS = "﻿Email,Total Spent,Customer ID,Total Orders\nA@x.com,12.00,'1,2\n"
ORDERS = (
    "Financial Status,Lineitem name,Name,Id,Total,Lineitem quantity,Lineitem price,Source\n"
    'paid,"a ""q"" b",#1,7,9.00,2,3.00,web\n'
    ',"two\nlines",#1,,,1,3.00,""\n'
)
PRODUCTS = "Handle,Variant Price,Title,Option1 Value\ntea,3.00,a,Default Title\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "x1.csv").write_text(CUSTOMERS, encoding="utf-8")
    (tmp_path / "x2.csv").write_text(ORDERS)
    (tmp_path / "x3.csv").write_text(PRODUCTS)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    (tmp_path / "notes.txt").write_text("Handle,Variant Price\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x4.csv").write_text(PRODUCTS)
    return tmp_path


def test_kind_by_header():
    assert kind_of(["Variant Price", "x", "Handle"]) == "products"
    assert kind_of(["Handle"]) is None
    assert kind_of([]) is None
    assert kind_of(["Customer ID", "Total Spent", "Handle", "Variant Price"]) == "customers"


def test_find_exports(spark, folder):
    found = find_exports(spark, str(folder))
    assert {k: [p.rsplit("/", 1)[1] for p in v] for k, v in found.items()} == {
        "customers": ["x1.csv"], "orders": ["x2.csv"], "products": ["x3.csv"],
    }


def test_all_parts_are_read_unless_the_first_is_asked_for(spark, folder):
    (folder / "x 9%.csv").write_text(PRODUCTS)
    assert len(find_exports(spark, str(folder))["products"]) == 2
    assert load_exports(spark, str(folder))[1]["products"].count() == 2
    with pytest.warns(UserWarning, match="x3.csv"):
        found = find_exports(spark, str(folder), first_only=True)
    assert [p.rsplit("/", 1)[1] for p in found["products"]] == ["x 9%.csv"]


def test_headers_of_many_files_take_one_job(spark, folder):
    for i in range(200):
        (folder / f"part{i:03}.csv").write_text(PRODUCTS.replace("tea", f"tea{i}"))
    context = spark.sparkContext
    context.setJobGroup("headers", "headers")
    found = find_exports(spark, str(folder))
    df = read_export(spark, found["products"])
    jobs = len(context.statusTracker().getJobIdsForGroup("headers"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(found["products"]) == 201
    # One for the headers; another if there are enough files for Spark to list them in parallel.
    assert jobs <= 3
    assert df.select("Handle").distinct().count() == 201


def test_header_with_a_line_break_and_odd_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text('\ufeff"Handle","two\nlines","Variant Price",,a,a\n1,2,3,4,5,6\n', encoding="utf-8")
    files = headers_of(spark, str(tmp_path))
    assert list(files.values()) == [["Handle", "two\nlines", "Variant Price", "", "a", "a"]]
    assert read_export(spark, files).columns == ["Handle", "two\nlines", "Variant Price", "_c3", "a4", "a5"]


def test_missing_kind_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text(PRODUCTS)
    with pytest.raises(ValueError, match="customers, orders"):
        find_exports(spark, str(tmp_path))


def test_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        find_exports(spark, str(tmp_path / "none"))


def test_read_export(spark, folder):
    path = str(folder / "x2.csv")
    df = read_export(spark, headers_of(spark, [path]))
    assert {f.dataType.simpleString() for f in df.schema} == {"string"}
    assert [r["Lineitem name"] for r in df.collect()] == ['a "q" b', "two\nlines"]
    assert [r["Source"] for r in df.collect()] == ["web", None]
    assert next(iter(headers_of(spark, [str(folder / "x1.csv")]).values()))[0] == "Email"


def test_parts_may_differ_in_column_order(spark, folder):
    (folder / "x5.csv").write_text("Title,Handle,Variant Price\ncup,mug,4.00\n")
    df = read_export(spark, headers_of(spark, [str(folder / "x3.csv"), str(folder / "x5.csv")]))
    assert sorted((r["Handle"], r["Title"], r["Option1 Value"]) for r in df.collect()) == [
        ("mug", "cup", None), ("tea", "a", "Default Title"),
    ]


def test_load_and_catalog(spark, folder):
    store, raw = load_exports(spark, str(folder))
    assert {r["table"]: r["n"] for r in load_summary(store).collect()} == {
        "customers": 1, "orders": 1, "order_items": 2, "products": 1, "variants": 1,
    }
    register_views(spark, store, raw)
    spark.range(3).createOrReplaceTempView("zz_mine")
    profile = catalog_profile(spark)
    rows = profile.collect()
    order = list(dict.fromkeys(r["table"] for r in rows))
    assert order[:10] == [
        "customers", "orders", "online_orders", "order_items", "catalog_items", "products",
        "variants", "raw_customers", "raw_orders", "raw_products",
    ]
    counts = {r["table"]: r["row_count"] for r in rows}
    assert (counts["zz_mine"], counts["raw_orders"], counts["catalog_items"]) == (3, 2, 1)
    mine = [r for r in rows if r["table"] == "zz_mine"]
    assert [(r["position"], r["column"], r["type"]) for r in mine] == [(1, "id", "bigint")]
    assert "Made" in mine[0]["description"]
    got = spark.sql("SELECT export_ts('2026-07-04 13:52:26 -0400') t, count(*) n FROM online_orders")
    assert str(got.first()["t"]) == "2026-07-04 13:52:26"
    spark.catalog.dropTempView("zz_mine")


def test_counts_come_from_footers(spark, tmp_path):
    """Listing stored tables reads no column of the five, and of lines only whether they match."""
    own = spark.newSession()
    write_tables(spark_store(spark, tables(3)), str(tmp_path))
    register_views(own, read_tables(own, str(tmp_path)))
    plan = catalog_profile(own)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert sorted(read) == [""] * 5 + ["in_catalog:boolean", "source:string"]


def test_user_tables_go_with_their_database_even_after_an_error(spark, tmp_path):
    own = spark.newSession()
    own.range(3).createOrReplaceTempView("three")
    with pytest.raises(ZeroDivisionError), user_database(own, str(tmp_path)) as name:
        own.sql("CREATE TABLE mine AS SELECT id * 2 AS x FROM three")
        own.sql("ALTER TABLE mine ADD COLUMNS (y STRING)")
        rows = {(r["table"], r["column"], r["row_count"]) for r in catalog_profile(own).collect()}
        assert rows == {("mine", "x", 3), ("mine", "y", 3), ("three", "id", 3)}
        1 / 0
    assert not own.catalog.databaseExists(name) and own.catalog.currentDatabase() == "default"
    assert list(tmp_path.iterdir()) == []
    assert own.table("three").count() == 3


def test_table_preview(spark):
    assert table_preview(spark.range(250)).count() == 100
