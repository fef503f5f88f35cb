import csv
import datetime as dt
import glob
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import spark_rows
from messy_store import spark_store, tables
from mercato.queries import ask
from mercato.sinks import results
from mercato.sinks.versions import committed, current, drop_old_versions
from mercato.sinks.results import (
    as_dict,
    capped,
    json_safe,
    preview,
    read_raw,
    read_saved,
    read_tables,
    save_bucketed,
    write_csv,
    write_exports,
    write_json,
    write_tables,
)
from mercato.sources.sample_exports import raw_exports
from mercato.sources.sample_tables import AS_OF, SampleStore


def test_preview_cap(spark):
    exact, more = preview(spark.range(5), cap=5), preview(spark.range(6), cap=5)
    assert (len(exact.rows), exact.truncated) == (5, False)
    assert (len(more.rows), more.truncated) == (5, True)
    client = as_dict(more)
    assert client["columns"] == [{"name": "id", "type": "bigint"}] and client["row_count"] == 5


def values(spark):
    return spark.range(1).select(
        F.lit(Decimal("1.50")).alias("money"),
        F.lit(float("nan")).alias("nan"),
        F.lit(float("-inf")).alias("inf"),
        F.lit("2026-07-04 13:52:26").cast("timestamp_ntz").alias("naive"),
        F.lit("2026-07-04 13:52:26").cast("timestamp").alias("zoned"),
        F.lit(dt.date(2026, 7, 4)).alias("day"),
        F.array(F.lit(Decimal("2.25")), F.lit(None)).alias("list"),
        F.struct(F.lit(float("inf")).alias("x"), F.lit("y").alias("y")).alias("nested"),
        F.create_map(F.lit(1), F.lit(dt.date(2026, 1, 1))).alias("map"),
        F.lit(True).alias("odd name.x"),
    )


def test_json_safe(spark):
    row = json_safe(values(spark)).first().asDict(recursive=True)
    assert row == {
        "money": 1.5, "nan": None, "inf": None, "naive": "2026-07-04 13:52:26",
        "zoned": "2026-07-04 13:52:26+0000", "day": "2026-07-04", "list": [2.25, None],
        "nested": {"x": None, "y": "y"}, "map": {"1": "2026-01-01"}, "odd name.x": True,
    }


def read_parts(folder, suffix):
    return "".join(open(f, newline="").read() for f in glob.glob(f"{folder}/*.{suffix}"))


def test_write_csv(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'say "hi"', " edge "), (2, "a,b", None), (3, "two\nlines", "")],
        "id int, text string, other string",
    ).coalesce(1)
    write_csv(df, str(tmp_path / "out"))
    text = read_parts(tmp_path / "out", "csv")
    assert text == 'id,text,other\n1,"say ""hi""", edge \n2,"a,b",\n3,"two\nlines",\n'
    assert len(list(csv.reader(text.splitlines(True)))) == 4


def test_write_csv_nested(spark, tmp_path):
    write_csv(values(spark).select("list", "nested").coalesce(1), str(tmp_path / "out"))
    rows = list(csv.reader(read_parts(tmp_path / "out", "csv").splitlines()))
    assert rows[1] == ["[2.25,null]", '{"x":null,"y":"y"}']


def test_write_json(spark, tmp_path):
    write_json(values(spark).select("money", "nan"), str(tmp_path / "out"))
    assert read_parts(tmp_path / "out", "json").strip() == '{"money":1.5,"nan":null}'


def test_stored_tables_give_the_same_answers(spark, tmp_path):
    store = spark_store(spark, tables(3))
    write_tables(store, str(tmp_path))
    stored = read_tables(spark, str(tmp_path))
    for name in ("a4_cohort_retention", "d5_product_margin", "e1_basket_size"):
        assert spark_rows(ask(name, stored, AS_OF)) == spark_rows(ask(name, store, AS_OF))


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    store = spark_store(spark, tables(3))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{tmp_path}/shop'")
    save_bucketed(store, 4, "shop.")
    saved = read_saved(spark, "shop.")
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    try:
        joined = saved.order_items("order_name", "quantity").join(
            saved.orders("order_name", "email"), "order_name"
        )
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(broadcast, before)
    assert spark_rows(ask("d1_top_products", saved)) == spark_rows(ask("d1_top_products", store))
    spark.sql("DROP DATABASE shop CASCADE")


def test_exports_are_stored_raw_and_modeled(spark, tmp_path):
    raw = raw_exports(SampleStore(spark, "/root/testdata/sf0.001"))
    write_exports(raw, str(tmp_path))
    again = read_raw(spark, str(tmp_path))
    for kind, df in raw.items():
        assert again[kind].columns == df.columns
        assert again[kind].exceptAll(df).count() == df.exceptAll(again[kind]).count() == 0
    store = read_tables(spark, str(tmp_path))
    assert store.order_items().count() == raw["orders"].count()


def test_capped_tells_whether_there_are_more(spark):
    for rows, more in ((5, False), (6, True)):
        got = capped(spark.range(rows), 5).collect()
        assert len(got) == 5 and {r["truncated"] for r in got} == {more}


def test_a_load_that_dies_half_way_leaves_the_old_store_whole(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    with pytest.raises(ValueError, match="no tables"):
        read_tables(spark, folder)
    first, second = spark_store(spark, tables(3)), spark_store(spark, tables(4))
    write_tables(first, folder)
    answer = spark_rows(ask("d1_top_products", read_tables(spark, folder)))
    with monkeypatch.context() as m:
        m.setattr(results, "with_match", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            write_tables(second, folder)
    assert spark_rows(ask("d1_top_products", read_tables(spark, folder))) == answer
    assert len(committed(spark, folder)) == 1
    drop_old_versions(spark, folder, unfinished=True)
    assert len(list((tmp_path / "versions").iterdir())) == 1
    assert spark_rows(ask("d1_top_products", read_tables(spark, folder))) == answer


def test_readers_keep_their_version_until_it_is_dropped(spark, tmp_path):
    folder = str(tmp_path)
    first, second = spark_store(spark, tables(3)), spark_store(spark, tables(4))
    write_tables(first, folder)
    reader = read_tables(spark, folder)
    before = spark_rows(ask("d5_product_margin", first))
    write_tables(second, folder)
    assert spark_rows(ask("d5_product_margin", reader)) == before
    assert spark_rows(ask("d5_product_margin", read_tables(spark, folder))) == spark_rows(ask("d5_product_margin", second))
    assert len(committed(spark, folder)) == 2
    drop_old_versions(spark, folder)
    assert committed(spark, folder) == [current(spark, folder)]
    assert spark_rows(ask("d5_product_margin", read_tables(spark, folder))) == spark_rows(ask("d5_product_margin", second))


def test_products_keep_their_numbers_when_exports_are_refreshed(spark, tmp_path):
    folder = str(tmp_path)
    write_tables(spark_store(spark, tables(3)), folder)
    before = {r["lineitem_name"]: r["product"] for r in read_tables(spark, folder).product_names().collect()}
    write_tables(spark_store(spark, tables(4)), folder)
    store = read_tables(spark, folder)
    after = {r["lineitem_name"]: r["product"] for r in store.product_names().collect()}
    assert before and after.items() >= before.items()
    assert sorted(after.values()) == list(range(1, len(after) + 1))
    lines = store.matched_items("lineitem_name", "product", "in_catalog").collect()
    assert all(r["product"] == (after.get(r["lineitem_name"]) if r["in_catalog"] else None) for r in lines)


def test_stored_lines_carry_their_match(spark, tmp_path):
    store = spark_store(spark, tables(5))
    write_tables(store, str(tmp_path))
    stored = read_tables(spark, str(tmp_path))
    assert stored.order_items().columns == store.order_items().columns
    same = ("order_name", "sku", "lineitem_name", "quantity", "in_catalog", "product_title", "cost_per_item")
    assert spark_rows(stored.matched_items(*same)) == spark_rows(store.matched_items(*same))
    assert spark_rows(stored.catalog_items()) == spark_rows(store.catalog_items())
