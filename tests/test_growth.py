"""What keeps the work of larger tables in proportion to them."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from conftest import SAMPLE, spark_rows
from mercato.operators.histogram import in_chunks
from mercato.plans import model as plans
from mercato.plans.model import model
from mercato.queries.segments import items_with_cost_and_category
from mercato.sinks.results import read_tables, write_tables
from mercato.sources import exports, sample_exports
from mercato.sources.exports import find_exports, load_exports, write_export
from mercato.sources.sample_exports import raw_exports, raw_orders, raw_products
from mercato.sources.sample_tables import SampleStore
from mercato.store import Store
from test_plans import NO_BROADCAST, plan_of, settings


def test_lines_move_once_to_find_the_leading_one(spark):
    rows = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("a", 1, "x"), (None, 1, "y")], "k string, size int, s string")
    few, many, _ = sample_exports._with_one_lead(rows, "k", ["size", "s"])
    leads = [("a", True, 1, "x"), ("a", False, 1, "x"), ("a", False, 2, None)]
    assert spark_rows(few)[1] == spark_rows(spark.createDataFrame(leads, "k string, leads boolean, size int, s string"))[1]
    assert not many.count()
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(few).split("Initial Plan")[-1]
    # One to count the rows of each key, one to sort them.
    assert plan.count("Exchange hashpartitioning") == 2


def test_hot_keys_give_the_same_exports(spark, monkeypatch):
    store = SampleStore(spark, SAMPLE)
    few = [spark_rows(raw(store)) for raw in (raw_orders, raw_products)]
    monkeypatch.setattr(sample_exports, "MANY", 3)
    assert [spark_rows(raw(store)) for raw in (raw_orders, raw_products)] == few


def test_written_exports_are_compressed_and_read_back(spark, tmp_path):
    raw = raw_exports(SampleStore(spark, SAMPLE))
    for kind, df in raw.items():
        df.write.options(header=True, quote='"', escape='"').csv(str(tmp_path / "plain" / kind))
        write_export(df, str(tmp_path / "packed"))
    files = [f for found in find_exports(spark, str(tmp_path / "packed")).values() for f in found]
    assert files and all(f.endswith(".csv.gz") for f in files)
    plain = sum(f.stat().st_size for f in Path(tmp_path / "plain").rglob("*.csv"))
    assert 3 * sum(f.stat().st_size for f in Path(tmp_path / "packed").glob("*.gz")) < plain
    for split_above in (None, 0):
        store, back = load_exports(spark, str(tmp_path / "packed"), split_above=split_above)
        for kind, df in raw.items():
            assert back[kind].count() == df.count()
        for table in ("order_items", "variants"):
            assert spark_rows(store.table(table)) == spark_rows(model(raw).table(table))


def test_equal_variants_multiply_lines_after_the_joins(spark):
    lines = [("#1", 1, "tea"), ("#2", 2, "tea"), ("#3", 3, "cup"), ("#4", 4, None)]
    variants = [("tea", 1.5, "t"), ("tea", 1.5, "t"), ("tea", None, "none"), (None, 2.0, "t")]
    store = Store(
        {
            "order_items": spark.createDataFrame(lines, "order_name string, quantity int, lineitem_name string"),
            "variants": spark.createDataFrame(variants, "lineitem_name string, cost_per_item double, handle string"),
            "products": spark.createDataFrame([("t", "Teas")], "handle string, product_category string"),
        }
    )
    found = items_with_cost_and_category(store)
    rows = [tuple(r) for r in found.collect()]
    each = [("tea", 1.5, "Teas")] * 2 + [("tea", None, None)]
    wanted = [(o, q, *e) for o, q in (("#1", 1), ("#2", 2)) for e in each]
    assert sorted(rows, key=str) == sorted([*wanted, ("#3", 3, "cup", None, None), ("#4", 4, None, None, None)], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_counts_in_chunks(spark):
    counted = spark.createDataFrame([("a", 5), ("b", 2)], "k string, n bigint")
    assert sorted(map(tuple, in_chunks(counted, 2).collect())) == [("a", 1), ("a", 2), ("a", 2), ("b", 2)]


def test_lines_get_their_order_before_the_texts_of_parts(spark):
    plan = SampleStore(spark, SAMPLE).order_items()._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert ["p_partkey" in line for line in joins[:2]] == [True, False]


def test_stored_tables_are_packed(spark, tmp_path):
    write_tables(SampleStore(spark, SAMPLE), str(tmp_path))
    files = [f.name for f in tmp_path.rglob("*.parquet") if f.is_file()]
    assert files and all(".zstd." in f for f in files)
    assert read_tables(spark, str(tmp_path)).matched_items().count() == SampleStore(spark, SAMPLE).order_items().count()


def test_orders_and_their_counts_move_the_same_lines_once(spark):
    with settings(spark, **NO_BROADCAST, **{"spark.sql.adaptive.enabled": "false"}):
        plan = plan_of(plans.orders(raw_orders(SampleStore(spark, SAMPLE))))
    own = [line for line in plan.split("\n") if "Exchange hashpartitioning(order_name" in line and "__spread" not in line]
    # Lines and heads of orders of few lines; the branch for many has its own steps.
    assert "WindowGroupLimit" not in plan
    assert sum("ReusedExchange [order_name" in line for line in own) >= 2
    # The sizes of orders are counted without a look at their parts.
    assert re.search(r"Exchange hashpartitioning\(l_orderkey", plan)


def test_orders_that_come_twice_give_each_time_with_each_field(spark):
    lines = [("a", True, 1), ("a", False, 2), ("b", True, 1), ("c", True, 1)]
    rows = spark.createDataFrame(lines, "order_name string, leads boolean, quantity int")
    heads = [("a", 1, "x", None), ("a", 2, None, "p"), ("b", 3, "y", "q"), (None, 4, "z", "r")]
    heads = spark.createDataFrame(heads, "order_name string, order_id int, email string, source string")
    heads = heads.withColumn("created_at", F.col("order_id") * 10)
    few, many = (spark_rows(sample_exports._with_heads(rows, heads, many=m)) for m in (False, True))
    assert few == many and len(few[1]) == 4 + 2 + 1


def test_order_fields_move_as_text_and_stay_as_they_are(spark):
    odd = [None, "", " ", "null", '["a",null]', 'a "q",\n\\n\r\n', "\x00\x1f\t", "é 漢 😀", "'1"]
    rows = [(f"#{i}", str(i), "2.50", "3", note, note) for i, note in enumerate(odd)]
    rows += [("#1", None, None, "4", None, None), (None, "9", "1.00", "1", "n", "n")]
    raw = spark.createDataFrame(rows, "Name string, Id string, Total string, `Lineitem quantity` string, Notes string, Tags string")
    found = plans.orders(raw)
    got = {r.order_name: (r.order_id, r.notes, r.tags, r.line_count, r.total_quantity) for r in found.collect()}
    assert got == {f"#{i}": (i, n, n or None, 1 + (i == 1), 3 + 4 * (i == 1)) for i, n in enumerate(odd)}
    broken = spark.range(1).select(
        F.lit("#1").alias("Name"), F.lit("1.00").alias("Total"), F.expr("cast(X'FF41C3' as string)").alias("Notes"), F.lit("x[é").alias("Tags")
    )
    assert [tuple(r) for r in plans.orders(broken).select(F.hex("notes"), "tags", "line_count").collect()] == [("FF41C3", "x[é", 1)]
    # One text moves, not a column for each field.
    assert "AS packed" in found._jdf.queryExecution().optimizedPlan().toString()


def test_wide_rows_are_written_by_compiled_code(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    inner = exports.compiled
    monkeypatch.setattr(exports, "compiled", lambda s: seen.append(s) or inner(s))
    write_export(raw_products(SampleStore(spark, SAMPLE)), str(tmp_path / "x"))
    assert seen == [spark] and spark.conf.get(name) == before
    with inner(spark):
        assert spark.conf.get(name) == "8000"
