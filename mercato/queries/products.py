"""How products sell: top sellers, pairs, entry products, margin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import cents, dollars, money, percent, ratio
from mercato.operators.baskets import numbered_pair_counts
from mercato.operators.firsts import first_orders, order_counts, repeat_customers, with_email
from mercato.operators.histogram import count_values, percentiles
from mercato.operators.joins import spread_join
from mercato.operators.match import LINE
from mercato.operators.sketches import united
from mercato.store import Store

# Fixed value: pairs must be bought together this often to be reported.
MIN_TOGETHER = 5


def top_products(store: Store, approximate: bool = False) -> DataFrame:
    """Sales by product. ``approximate`` estimates the buyers from the store's daily sketches."""
    if approximate:
        sums = united(store.product_days(), ["lineitem_name"], ["units", "cents"], ["buyers"])
        return _top_products(sums.withColumnsRenamed({"units": "units_sold", "buyers": "unique_buyers"}))
    lines = store.catalog_items("order_name", "lineitem_name", "quantity", "price")
    sold = spread_join(lines, store.paid_online("order_name", "email"), "order_name")
    # One row per product and buyer before buyers are counted.
    products = (
        sold.groupBy("lineitem_name", "email")
        .agg(F.sum("quantity").alias("units"), F.sum(F.col("quantity") * cents("price")).alias("cents"))
        .groupBy("lineitem_name")
        .agg(
            F.sum("units").alias("units_sold"),
            F.sum("cents").alias("cents"),
            F.count("email").alias("unique_buyers"),
        )
    )
    return _top_products(products)


def _top_products(products: DataFrame) -> DataFrame:
    sold_for = dollars(F.col("cents"))
    return products.select(
        F.col("lineitem_name").alias("product"),
        "units_sold",
        sold_for.alias("revenue"),
        "unique_buyers",
        ratio(sold_for, F.col("unique_buyers"), 2).alias("revenue_per_buyer"),
    ).orderBy(F.col("revenue").desc_nulls_last(), F.col("product").asc_nulls_last())


def attach_rate(store: Store, min_together: int = MIN_TOGETHER) -> DataFrame:
    """Pairs bought together; the rate is that of the alphabetically first one."""
    baskets = store.matched_items("order_name", "product").dropna().distinct()
    pairs = numbered_pair_counts(baskets, store.product_names(), min_together)
    return pairs.select(
        F.col("a").alias("product_in_basket"),
        F.col("b").alias("also_bought"),
        F.col("together").alias("orders_together"),
        percent(F.col("together"), F.col("baskets_of_a")).alias("attach_pct"),
    ).orderBy(F.desc("orders_together"), "product_in_basket", "also_bought")


def _first_baskets(store: Store) -> DataFrame:
    """Distinct (email, order_name, lineitem_name) of catalog lines in first orders."""
    first = first_orders(store.online_orders("email", "created_at", "order_name"), "order_name")
    first = first.filter(F.col("order_name").isNotNull()).select("email", "order_name")
    sold = spread_join(store.catalog_items("order_name", "lineitem_name"), first, "order_name")
    return sold.select("email", "order_name", "lineitem_name").distinct()


def entry_products(store: Store) -> DataFrame:
    """Products in customers' first orders."""
    customers = (
        with_email(store.online_orders("email"))
        .agg(F.count_distinct("email").alias("c"))
        .select("c")
        .scalar()
    )
    products = (
        _first_baskets(store)
        .groupBy("lineitem_name")
        .agg(F.count_distinct("order_name").alias("first_orders"))
    )
    return products.select(
        F.col("lineitem_name").alias("product"),
        "first_orders",
        percent(F.col("first_orders"), customers).alias("pct_of_first_orders"),
    ).orderBy(F.desc("first_orders"), F.col("product").asc_nulls_last())


def repeat_rate_by_entry_product(store: Store) -> DataFrame:
    """Of the customers whose first order held a product, how many came back."""
    buyers = _first_baskets(store).select("email", "lineitem_name").distinct()
    again = repeat_customers(store.online_orders("email")).withColumn("again", F.lit(True))
    # One row per customer and product, so plain counts are distinct counts.
    products = (
        spread_join(buyers, again, "email", "left")
        .groupBy("lineitem_name")
        .agg(F.count("*").alias("buyers"), F.count("again").alias("came_back"))
    )
    return products.select(
        F.col("lineitem_name").alias("entry_product"),
        F.col("buyers").alias("first_time_buyers"),
        F.col("came_back").alias("came_back_again"),
        percent(F.col("came_back"), F.col("buyers")).alias("repeat_pct"),
    ).orderBy(F.col("repeat_pct").desc_nulls_last(), F.col("entry_product").asc_nulls_last())


def product_margin(store: Store) -> DataFrame:
    """Revenue less cost of goods per product; a missing cost counts as zero.

    Units on lines without a price earn no margin.
    """
    lines = store.catalog_items("order_name", "product_title", "quantity", "price", "cost_per_item")
    sold = lines.join(store.paid_online("order_name"), "order_name")
    units, price = F.col("quantity"), cents("price")
    cost = F.coalesce(cents("cost_per_item"), F.lit(0))
    products = (
        sold.groupBy("product_title")
        .agg(
            F.sum("quantity").alias("units_sold"),
            F.sum(units * price).alias("revenue"),
            F.sum(units * cost).alias("cogs"),
            F.sum(units * (price - cost)).alias("margin"),
        )
    )
    return products.select(
        F.col("product_title").alias("product"),
        "units_sold",
        dollars(F.col("revenue")).alias("revenue"),
        dollars(F.col("cogs")).alias("cogs"),
        dollars(F.col("margin")).alias("gross_margin"),
        percent(F.col("margin"), F.col("revenue")).alias("gross_margin_pct"),
    ).orderBy(F.col("gross_margin").desc_nulls_last(), F.col("product").asc_nulls_last())


def zero_sales_variants(store: Store) -> DataFrame:
    """Active variants no line ever matched by SKU or exact name, in any channel."""
    active = store.variants("product_title", "lineitem_name", "sku", "price", "status")
    active = active.filter(F.col("status") == "active")
    lines = store.order_items(*LINE)
    unsold = spread_join(active, lines.select("sku").distinct(), "sku", "left_anti")
    names = lines.select("lineitem_name").distinct()
    unsold = spread_join(unsold, names, "lineitem_name", "left_anti")
    return unsold.select(
        F.col("product_title").alias("product"),
        "sku",
        money("price").alias("listed_price"),
        "status",
    ).orderBy(
        F.col("product").asc_nulls_last(),
        F.col("sku").asc_nulls_last(),
        F.col("listed_price").asc_nulls_last(),
    )


def basket_size(store: Store) -> DataFrame:
    """Distinct products and units per order, catalog lines of all channels."""
    baskets = (
        store.catalog_items("order_name", "lineitem_name", "quantity")
        .groupBy("order_name", "lineitem_name")
        .agg(F.sum("quantity").alias("units"))
        .groupBy("order_name")
        .agg(F.count("lineitem_name").alias("products"), F.sum("units").alias("units"))
    )
    counts = count_values(
        baskets,
        F.col("units"),
        sums={
            "products": F.col("products"),
            "single": (F.col("products") == 1).cast("bigint"),
            "multi": (F.col("products") >= 2).cast("bigint"),
        },
    )
    stats = percentiles(counts, [50], sums=["products", "single", "multi"])
    return stats.select(
        ratio(F.col("products"), F.col("rows"), 2).alias("avg_distinct_products"),
        ratio(F.col("total"), F.col("present"), 2).alias("avg_units"),
        (F.col("p50") / 100.0).alias("median_units"),
        F.coalesce("single", F.lit(0)).alias("single_product_orders"),
        F.coalesce("multi", F.lit(0)).alias("multi_product_orders"),
    )


def contribution_margin(store: Store) -> DataFrame:
    """Subtotal plus shipping less cost of goods, per paid order, worst first."""
    orders = store.paid_online("order_name", "subtotal", "shipping")
    lines = store.matched_items("order_name", "quantity", "cost_per_item")
    sold = spread_join(lines, orders.select("order_name").distinct(), "order_name", "left_semi")
    cost = F.coalesce(cents("cost_per_item"), F.lit(0))
    cogs = sold.groupBy("order_name").agg(F.sum(F.col("quantity") * cost).alias("cogs"))
    subtotal, shipping = cents("subtotal"), cents("shipping")
    margin = subtotal - F.col("cogs")
    return (
        spread_join(orders, cogs, "order_name")
        .select(
            "order_name",
            money("subtotal").alias("subtotal"),
            money("shipping").alias("shipping"),
            dollars(F.col("cogs")).alias("cogs"),
            dollars(margin).alias("product_margin"),
            dollars(margin + shipping).alias("contribution"),
            percent(margin, subtotal).alias("margin_pct"),
        )
        .orderBy(F.col("margin_pct").asc_nulls_last(), "order_name")
    )
