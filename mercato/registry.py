"""Every query over the sample tables, by key.

Besides the business questions: the tables of the model built from
export-shaped text, the derived views, and the reusable operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.columns import cents, export_timestamp, hundredths_rounded, money
from mercato.operators.baskets import pair_counts
from mercato.operators.firsts import first_orders, last_orders, order_counts
from mercato.operators.histogram import count_values, percentiles
from mercato.operators.match import LINE, line_matches, with_best_variant
from mercato.operators.ranking import Key, rank_rows
from mercato.operators.sketches import approximate_percentiles
from mercato.plans import model
from mercato.queries import APPROXIMATE, ONE_AGGREGATE, ask, names
from mercato.session import checkpoint, compiled, in_session, remove_folder, shared_folder
from mercato.sinks.results import capped, json_safe, read_raw, read_tables, write_csv, write_exports, write_tables
from mercato.sources.catalog import (
    OTHER_DESCRIPTION,
    catalog_profile,
    load_summary,
    register_views,
    table_preview,
    user_database,
)
from mercato.sources.exports import load_exports, write_export
from mercato.sources.sample_exports import (
    raw_customers,
    raw_exports,
    raw_orders,
    raw_products,
)
from mercato.sources.sample_tables import AS_OF, SampleStore
from mercato.store import Store

Query = Callable[[SparkSession, str], DataFrame]
StoreQuery = Callable[[SampleStore], DataFrame]


# --- tables of the model -----------------------------------------------------


def t0_export_timestamps(store: SampleStore) -> DataFrame:
    raw = raw_orders(store).filter(F.col("`Total`").isNotNull())
    return raw.select(
        F.col("`Name`").alias("order_name"),
        export_timestamp(F.col("`Created at`")).alias("created_at"),
        export_timestamp(F.col("`Cancelled at`")).alias("cancelled_at"),
    )


def t1_customers(store: SampleStore) -> DataFrame:
    return model.customers(raw_customers(store))


def t2_order_items(store: SampleStore) -> DataFrame:
    return model.order_items(raw_orders(store))


def t3_orders(store: SampleStore) -> DataFrame:
    return model.orders(raw_orders(store))


def t4_products(store: SampleStore) -> DataFrame:
    return model.products(raw_products(store))


def t5_variants(store: SampleStore) -> DataFrame:
    return model.variants(raw_products(store))


def t6_online_orders(store: SampleStore) -> DataFrame:
    return store.online_orders()


def t7_catalog_items(store: SampleStore) -> DataFrame:
    return store.catalog_items()


# --- reusable operators --------------------------------------------------------


def m1_catalog_match(store: SampleStore) -> DataFrame:
    return store.line_matches().filter("in_catalog").select(*LINE)


def m2_best_variant(store: SampleStore) -> DataFrame:
    keys = store.order_items(*LINE).distinct()
    best = with_best_variant(keys, store.line_matches())
    return best.withColumn("cost_per_item", money("cost_per_item"))


def m1_wildcard_titles(store: SampleStore) -> DataFrame:
    """The longest title of each line name, from a catalog whose titles all begin with a wildcard."""
    kind = F.replace(F.substring_index("lineitem_name", " - ", -1), F.lit(" / "), F.lit("_/_"))
    none = F.lit(None).cast("string")
    catalog = store.variants("lineitem_name", "cost_per_item").select(
        none.alias("sku"), none.alias("lineitem_name"), F.concat(F.lit("%"), kind).alias("product_title"), "cost_per_item"
    )
    return line_matches(store.order_items(*LINE), catalog).select(*LINE, "product_title")


def m3_first_orders(store: SampleStore) -> DataFrame:
    return first_orders(store.online_orders("email", "created_at", "order_name"), "order_name")


def m4_last_orders(store: SampleStore) -> DataFrame:
    return last_orders(store.online_orders("email", "created_at"))


def m5_repeat_customers(store: SampleStore) -> DataFrame:
    return order_counts(store.online_orders("email")).filter(F.col("orders") >= 2)


def m6_global_rank(store: SampleStore) -> DataFrame:
    """All customers by lifetime spend, with the running total."""
    spend = store.customers("customer_id", "total_spent").select(
        "customer_id", cents("total_spent").alias("spend")
    )
    return rank_rows(
        checkpoint(spend), [Key("spend", descending=True), Key("customer_id")], ["spend"]
    )


def m7_percentiles_by_state(store: SampleStore) -> DataFrame:
    paid = store.paid_online("shipping_province", "subtotal")
    counts = count_values(paid, cents("subtotal"), ["shipping_province"])
    stats = percentiles(counts, [5, 25, 50, 90], ["shipping_province"])
    return stats.select(
        F.col("shipping_province").alias("state"),
        "rows",
        *[hundredths_rounded(F.col(f"p{p}")).alias(f"p{p}") for p in (5, 25, 50, 90)],
    )


def m7_approximate_percentiles_by_state(store: SampleStore) -> DataFrame:
    """Values whose rank is off by at most one in ten thousand rows of the state."""
    paid = store.paid_online("shipping_province", "subtotal")
    stats = approximate_percentiles(paid, cents("subtotal"), [5, 25, 50, 90], ["shipping_province"])
    return stats.select(
        F.col("shipping_province").alias("state"),
        "rows",
        *[hundredths_rounded(F.col(f"p{p}")).alias(f"p{p}") for p in (5, 25, 50, 90)],
    )


def m12_pairs(store: SampleStore) -> DataFrame:
    """Line names bought together in two orders or more, over all lines."""
    baskets = store.order_items("order_name", "lineitem_name").distinct()
    return pair_counts(baskets, 2)


# --- catalog and results ------------------------------------------------------


def s6_load_summary(store: SampleStore) -> DataFrame:
    return load_summary(store)


def s7_table_preview(store: SampleStore) -> DataFrame:
    """The rows a user sees first of the orders, by name."""
    return table_preview(store.orders().orderBy("order_name"))


def k3_capped_result(store: SampleStore) -> DataFrame:
    """A result beyond the cap, cut to it, with the flag that says so."""
    lines = store.order_items("order_name", "lineitem_name", "quantity", "price", "discount")
    keys = ["order_name", "lineitem_name", "quantity", "price", "discount"]
    return capped(json_safe(lines.orderBy(*keys)))


def k4_json_safe_orders(store: SampleStore) -> DataFrame:
    orders = store.orders()
    return json_safe(
        orders.select(
            "order_name",
            "created_at",
            F.to_date("created_at").alias("day"),
            "subtotal",
            F.struct("email", "total").alias("buyer"),
            F.array("shipping", "discount_amount").alias("amounts"),
            F.create_map(F.lit("total"), F.col("total")).alias("by_name"),
            # Not finite where there is no shipping.
            F.when(F.col("shipping") == 0, float("inf")).otherwise(F.col("total").cast("double")).alias("ratio"),
        )
    ).select(
        "order_name",
        "created_at",
        "day",
        "subtotal",
        F.col("buyer.email").alias("buyer_email"),
        F.col("buyer.total").alias("buyer_total"),
        F.get("amounts", F.lit(0)).alias("shipping"),
        F.get("amounts", F.lit(1)).alias("discount_amount"),
        F.col("by_name").getItem("total").alias("mapped_total"),
        "ratio",
    )


STORE_QUERIES: dict[str, StoreQuery] = {
    f.__name__: f
    for f in (
        t0_export_timestamps,
        t1_customers,
        t2_order_items,
        t3_orders,
        t4_products,
        t5_variants,
        t6_online_orders,
        t7_catalog_items,
        m1_catalog_match,
        m1_wildcard_titles,
        m2_best_variant,
        m3_first_orders,
        m4_last_orders,
        m5_repeat_customers,
        m6_global_rank,
        m7_percentiles_by_state,
        m7_approximate_percentiles_by_state,
        m12_pairs,
        s6_load_summary,
        s7_table_preview,
        k3_capped_result,
        k4_json_safe_orders,
    )
}


def s5_catalog_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The sample store's views, in a session of their own: descriptions, rows, columns and types."""
    own = spark.newSession()
    register_views(own, SampleStore(own, folder))
    return in_session(spark, catalog_profile(own))


def _exported(
    spark: SparkSession, folder: str, table: Callable[[Store], DataFrame], split_above: int | None = None
) -> DataFrame:
    """A modeled table of the sample, written as CSV exports to one folder, found, read and modeled.

    The files are compressed; those above ``split_above`` bytes are split by quotes. The result is stored for the session, and the exports go.
    """
    exports = f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
    for raw in raw_exports(SampleStore(spark, folder)).values():
        write_export(raw, exports)
    store, _ = load_exports(spark, exports, split_above=split_above)
    with compiled(spark):
        found = checkpoint(table(store))
    remove_folder(spark, exports)
    return found


def _totals(store: Store) -> DataFrame:
    sums = {
        store.orders(): {
            "orders": F.count("*"),
            "lines": F.sum("line_count"),
            "units": F.sum("total_quantity"),
            "subtotal_cents": F.sum(cents("subtotal")),
        },
        store.variants(): {
            "variants": F.count("*"),
            "cost_cents": F.sum(cents("cost_per_item")),
        },
        store.customers(): {
            "customers": F.count("*"),
            "customer_orders": F.sum("total_orders"),
        },
    }
    parts = []
    for table, measures in sums.items():
        pairs = [
            F.struct(F.lit(name).alias("measure"), total.alias("value"))
            for name, total in measures.items()
        ]
        parts.append(table.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs")))
    return reduce(DataFrame.unionByName, parts)


def s4_exports_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over the exports read back."""
    return _exported(spark, folder, _totals)


def _stored_exports(
    spark: SparkSession, folder: str, table: Callable[[str], DataFrame]
) -> DataFrame:
    """What ``table`` gives of the raw and modeled tables stored in a folder, which goes after."""
    stored = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    write_exports(raw_exports(SampleStore(spark, folder)), stored)
    found = checkpoint(table(stored))
    remove_folder(spark, stored)
    return found


def k1_stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Store the raw and modeled tables, then answer the product margin question from them."""
    return _stored_exports(
        spark, folder, lambda stored: ask("d5_product_margin", read_tables(spark, stored))
    )


def k1_stored_raw_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, keys and columns of the raw tables as they are stored."""
    keys = {"customers": "Customer ID", "orders": "Name", "products": "Handle"}

    def count(stored: str) -> DataFrame:
        parts = []
        for kind, df in read_raw(spark, stored).items():
            totals = df.agg(F.count("*").alias("rows"), F.count_distinct(F.col(f"`{keys[kind]}`")).alias("keys"))
            parts.append(totals.select(F.lit(f"raw_{kind}").alias("table"), "rows", "keys"))
        return reduce(DataFrame.unionByName, parts)

    return _stored_exports(spark, folder, count)


def _from_rollups(name: str) -> Query:
    """The approximate form of a question, from stored daily sketches."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        stored = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        write_tables(SampleStore(spark, folder), stored, rollups=True)
        found = checkpoint(ask(name, read_tables(spark, stored), approximate=True))
        remove_folder(spark, stored)
        return found

    return query


def k6_user_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that the user makes, changes and drops in a database of their own, as the session lists them."""
    place = f"{shared_folder(spark)}/user-{uuid.uuid4().hex}"
    own = spark.newSession()
    register_views(own, SampleStore(own, folder))
    with user_database(own, place):
        own.sql("CREATE TABLE big_orders AS SELECT order_name, subtotal FROM online_orders WHERE subtotal > 100000")
        own.sql("CREATE TABLE notes (order_name STRING, note STRING)")
        own.sql("ALTER TABLE notes ADD COLUMNS (stars INT)")
        own.sql("INSERT INTO notes SELECT order_name, 'big', 5 FROM big_orders WHERE subtotal > 300000")
        own.sql("CREATE TABLE passing (x INT)")
        own.sql("ALTER TABLE passing RENAME TO gone")
        own.sql("DROP TABLE gone")
        found = in_session(spark, catalog_profile(own))
    remove_folder(spark, place)
    return found.filter(F.col("description") == OTHER_DESCRIPTION).drop("description")


def k5_csv_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Write customers, with text that needs quotes and a nested column, as CSV and read it back as text."""
    report = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    store = SampleStore(spark, folder)
    email, province = F.col("email"), F.col("province_code")
    write_csv(
        store.customers("customer_id", "email", "province_code", "total_spent").select(
            F.col("customer_id").cast("string").alias("customer_id"),
            F.concat(F.lit('says "hi", '), email).alias("quoted"),
            F.concat(F.lit(" first\n"), email, F.lit(",second ")).alias("lines"),
            F.when(F.col("customer_id") % 3 != 0, email).alias("missing"),
            F.array(email, province).alias("nested"),
            "total_spent",
        ),
        report,
    )
    back = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(report)
    found = checkpoint(back.withColumn("total_spent", F.col("total_spent").cast("double")))
    remove_folder(spark, report)
    return found


def k6_session_view(spark: SparkSession, folder: str) -> DataFrame:
    """A view the user makes over the named tables, and a query on it, in a session of their own."""
    own = spark.newSession()
    register_views(own, SampleStore(own, folder))
    own.sql(
        "CREATE OR REPLACE TEMPORARY VIEW large_orders AS"
        " SELECT source, subtotal FROM online_orders WHERE subtotal > 100000"
    )
    found = own.sql(
        "SELECT source, count(*) AS orders, cast(sum(subtotal) AS double) AS revenue"
        " FROM large_orders GROUP BY source"
    )
    return in_session(spark, found)


def k6_sql_time_function(spark: SparkSession, folder: str) -> DataFrame:
    """Export times parsed in SQL by the function that the views come with."""
    own = spark.newSession()
    store = SampleStore(own, folder)
    register_views(own, store, {"orders": raw_orders(store)})
    found = own.sql(
        "SELECT Name AS order_name, export_ts(`Created at`) AS created_at,"
        " export_ts(`Cancelled at`) AS cancelled_at FROM raw_orders WHERE Total IS NOT NULL"
    )
    return in_session(spark, found)


def _over_sample(query: StoreQuery) -> Query:
    return lambda spark, folder: query(SampleStore(spark, folder))


def _question(name: str) -> Query:
    return lambda spark, folder: ask(name, SampleStore(spark, folder), AS_OF)


def _approximate(name: str) -> Query:
    return lambda spark, folder: ask(name, SampleStore(spark, folder), approximate=True)


def _read_back(name: str, split_above: int | None = None) -> Query:
    """A modeled table after its way through the CSV exports."""
    return lambda spark, folder: _exported(spark, folder, lambda store: store.table(name), split_above)


def registered() -> dict[str, Query]:
    return {
        **{name: _question(name) for name in names()},
        **{name: _over_sample(query) for name, query in STORE_QUERIES.items()},
        "s4_exports_read_back": s4_exports_read_back,
        **{
            f"s4_{name}_read_back": _read_back(name)
            for name in ("customers", "orders", "order_items", "products", "variants")
        },
        # Every file is split by quotes, however small.
        **{f"s4_split_{name}_read_back": _read_back(name, 0) for name in ("orders", "order_items", "variants")},
        "s5_catalog_profile": s5_catalog_profile,
        "k1_stored_tables": k1_stored_tables,
        "k1_stored_raw_tables": k1_stored_raw_tables,
        "k5_csv_read_back": k5_csv_read_back,
        "k6_session_view": k6_session_view,
        "k6_user_tables": k6_user_tables,
        **{f"{name}_approximate": _from_rollups(name) for name in APPROXIMATE if name not in ONE_AGGREGATE},
        **{f"{name}_approximate": _approximate(name) for name in ONE_AGGREGATE},
        "k6_sql_time_function": k6_sql_time_function,
    }
