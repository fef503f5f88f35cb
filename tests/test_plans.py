"""Plans that hold at scale: no nested loops, no Python, hot keys split."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from mercato.operators import ranking
from mercato.operators.firsts import first_orders
from mercato.operators.joins import null_safe_join, spread_join
from mercato.operators.match import LINE, line_matches
from mercato.queries import ask, names
from mercato.sources.sample_tables import AS_OF
from mercato.store import Store
from messy_store import spark_store, tables


@contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from mercato.sinks.results import read_tables, write_tables

    folder = str(tmp_path_factory.mktemp("stored"))
    write_tables(spark_store(spark, tables(5)), folder)
    return read_tables(spark, folder)


#: What may go to one task: what each task has summed up or cut off, totals of
#: value ranges (2^22 at most), totals of buckets (one for ROWS_PER_BUCKET
#: rows), and tiles.
ONE_TASK = re.compile(r"Limit|HashAggregate\(keys=\[\], functions=\[partial_|HashAggregate\(keys=\[(range|__bucket|tile)#\d+L?\]")


@pytest.mark.parametrize("name", names())
def test_plan_holds_at_scale(spark, stored, name, monkeypatch):
    """No nested loops and no Python; what goes to one partition is an aggregate or a limit."""
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 2)
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(ask(name, stored, AS_OF))
    assert not re.search("NestedLoop|CartesianProduct|Python|Pandas", plan)
    lines = plan.split("\n")
    for line, below in zip(lines, lines[1:], strict=False):
        if "Exchange SinglePartition" in line:
            assert ONE_TASK.search(below), below


@pytest.mark.parametrize("name, columns", [("e5_refunds", {"refunded_amount", "total", "source"}),
                                           ("h3_never_bought", {"total_orders", "accepts_email_marketing"})])
def test_scans_read_only_what_they_need(spark, stored, name, columns):
    plan = plan_of(ask(name, stored, AS_OF))
    read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", plan)[1]))
    assert read == columns


def test_filters_reach_the_scan(spark, stored):
    with settings(spark, **{"spark.sql.debug.maxToStringFields": "1000"}):
        plan = plan_of(ask("e2_discount_codes", stored, AS_OF))
    assert re.search(r"PushedFilters: \[.*IsNotNull\(financial_status\)", plan)


SKEW = {
    **NO_BROADCAST,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    # As small as the rest: what one task wrote cannot be split.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "20000",
    "spark.sql.shuffle.partitions": "8",
}


def hot_rows(spark, n=60_000):
    """A third of all rows share one key."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 2000))
    return spark.range(n).repartition(8).select(key.alias("key"), F.xxhash64("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_key_is_split_when_joining_aggregates(spark, how):
    with settings(spark, **SKEW):
        rows = hot_rows(spark)
        sums = rows.groupBy("key").agg(F.count("*").alias("n"))
        joined = spread_join(rows, sums, "key", how)
        assert len(joined.collect()) == 60_000
        assert "skew=true" in plan_of(joined)


def test_hot_key_is_split_in_null_safe_joins(spark):
    with settings(spark, **SKEW):
        rows = hot_rows(spark)
        sums = rows.groupBy("key").agg(F.count("*").alias("n"))
        joined = null_safe_join(rows, sums, ["key"], "left")
        assert len(joined.collect()) == 60_000
        assert "skew=true" in plan_of(joined)


def skewed_store(spark, folder):
    """One order holds a third of the lines, one customer a third of the orders at one instant."""
    lines, orders = 60_000, 150_000
    hot_line = F.col("id") % 3 == 0
    name = F.when(hot_line, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % orders))
    number = F.col("id").cast("string")
    product = F.concat(F.lit("p"), F.col("id") % 5000)
    made = {
        "order_items": spark.range(lines).select(
            name.alias("order_name"),
            product.alias("sku"),
            product.alias("lineitem_name"),
            F.lit(1).alias("quantity"),
            F.lit("2.00").cast("decimal(12,2)").alias("price"),
            F.xxhash64("id").alias("filler"),
        ),
        "orders": spark.range(orders).select(
            F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("o"), number)).alias("order_name"),
            F.when(F.col("id") % 3 == 0, "e").otherwise(F.concat(F.lit("e"), number)).alias("email"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
            F.lit("web").alias("source"),
            F.lit("paid").alias("financial_status"),
        ),
        "variants": spark.range(5000).select(
            F.concat(F.lit("p"), "id").alias("sku"),
            F.concat(F.lit("p"), "id").alias("lineitem_name"),
            F.concat(F.lit("p"), "id").alias("product_title"),
            F.lit("1.00").cast("decimal(12,2)").alias("cost_per_item"),
        ),
    }
    for table, df in made.items():
        df.repartition(8).write.parquet(f"{folder}/{table}")
    return Store({table: spark.read.parquet(f"{folder}/{table}") for table in made})


def test_hot_orders_and_customers_are_split(spark, tmp_path):
    store = skewed_store(spark, str(tmp_path))
    plain = {}
    questions = ("d1_top_products", "d3_entry_products", "d4_repeat_by_entry_product")
    for name in questions:
        plain[name] = ask(name, store, AS_OF).collect()
    orders = store.online_orders("email", "created_at", "order_name")
    plain["m3"] = sorted(first_orders(orders, "order_name").collect())
    with settings(spark, **SKEW):
        for name in questions:
            df = ask(name, store, AS_OF)
            assert df.collect() == plain[name]
            assert "skew=true" in plan_of(df), name
        firsts = first_orders(orders, "order_name")
        assert sorted(firsts.collect()) == plain["m3"]
        assert "skew=true" in plan_of(firsts)


def test_first_orders_are_limited_before_the_shuffle(spark, stored):
    plan = plan_of(first_orders(stored.online_orders("email", "created_at")))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_time_to_second_purchase_is_limited_before_the_shuffle(spark, stored):
    plan = plan_of(ask("a5_time_to_second_purchase", stored, AS_OF))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_exploded_sides_are_never_broadcast(spark, stored):
    """Even where estimates are tiny: pairs and lookups may be far larger."""
    pairs = plan_of(ask("d2_attach_rate", stored, AS_OF))
    assert "SortMergeJoin [x#" in pairs
    variants = stored.variants("sku", "lineitem_name", "product_title", "cost_per_item")
    matches = plan_of(line_matches(stored.order_items(*LINE), variants))
    assert "SortMergeJoin [kind#" in matches


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from mercato import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


@pytest.mark.parametrize("name", ["a4_cohort_retention", "g1_state_scorecard", "g2_top_zips"])
def test_distinct_counts_are_not_expanded(spark, stored, name):
    """One row for each group and customer, not one more for each distinct count."""
    assert "Expand" not in plan_of(ask(name, stored, AS_OF))


def test_only_pairs_with_support_are_joined(spark, stored):
    """The pairs meet the names alone, after the filter on their support."""
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(ask("d2_attach_rate", stored, AS_OF))
    assert plan.count("SortMergeJoin [x#") == plan.count("SortMergeJoin [y#") == 1
