"""Where the revenue sits: by customer, product, variant and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import cents, dollars, money, percent
from mercato.operators.histogram import (
    count_values,
    one_row_each,
    running_totals,
    tile_sums,
)
from mercato.operators.match import LINE
from mercato.operators.ranking import Key, rank_rows
from mercato.session import checkpoint
from mercato.store import Store

# The names of the five spend groups, best first.
SPEND_GROUPS = (
    "Top 20% (Best Customers)",
    "Next 20%",
    "Middle 20%",
    "Lower 20%",
    "Bottom 20% (Smallest Spenders)",
)


def group_name(tile: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), tile.cast("int"))


def total_of(df: DataFrame, column: str) -> Column:
    """The sum over all rows, as a scalar subquery."""
    return df.agg(F.sum(column).alias("t")).select("t").scalar()


def _spend_counts(store: Store) -> DataFrame:
    buyers = store.customers("total_spent", "total_orders").filter(F.col("total_orders") >= 1)
    return count_values(buyers, cents("total_spent"))


def line_sales(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Units and gross cents per (sku, lineitem_name) over the given orders."""
    sold = lines.join(orders, "order_name")
    return sold.groupBy(*LINE).agg(
        F.sum("quantity").alias("units"),
        F.sum(F.col("quantity") * cents("price")).alias("revenue"),
    )


def revenue_quintiles(store: Store) -> DataFrame:
    tiles = tile_sums(_spend_counts(store), 5, descending=True)
    # A window over the five rows there are.
    everything = F.sum("total").over(Window.partitionBy(F.lit(0)))
    return (
        tiles.withColumn("pct", percent(F.col("total"), everything))
        .orderBy("tile")
        .select(
            group_name(F.col("tile"), SPEND_GROUPS).alias("customer_group"),
            F.col("n").alias("customers"),
            dollars(F.col("total")).alias("revenue"),
            F.col("pct").alias("pct_revenue"),
        )
    )


def customer_pareto(store: Store) -> DataFrame:
    """One row per customer, best first: cumulative share of customers and revenue.

    Customers with the same spend are interchangeable, so the sums run over
    distinct amounts and each amount then yields its rows.
    """
    counts = _spend_counts(store).withColumn("amount", F.col("value") * F.col("n"))
    overall = counts.agg(F.struct(F.sum("n").alias("rows"), F.sum("amount").alias("amount")).alias("t"))
    overall = overall.select("t").scalar()
    placed = running_totals(counts, ["n", "amount"], descending=True)
    each = one_row_each(placed, ["value"]).withColumn("rn", F.col("before_n") + F.col("i") + 1)
    spent = F.col("before_amount") + F.coalesce(F.col("value") * (F.col("i") + 1), F.lit(0))
    return (
        each.withColumn("spent", spent)
        .orderBy("rn")
        .select(
            percent(F.col("rn"), overall.getField("rows")).alias("cum_pct_customers"),
            percent(F.col("spent"), overall.getField("amount")).alias("cum_pct_revenue"),
        )
    )


def revenue_by_product(store: Store) -> DataFrame:
    orders = store.paid_online("order_name", "cancelled_at")
    orders = orders.filter(F.col("cancelled_at").isNull()).select("order_name")
    lines = store.catalog_items("order_name", *LINE, "quantity", "price")
    sales = line_sales(lines, orders)
    products = checkpoint(
        sales.groupBy("lineitem_name").agg(F.sum("revenue").alias("revenue"))
    )
    ranked = rank_rows(
        products, [Key("revenue", descending=True), Key("lineitem_name")], ["revenue"]
    )
    grand = total_of(products, "revenue")
    return ranked.orderBy("row_number").select(
        F.col("lineitem_name").alias("product"),
        dollars(F.col("revenue")).alias("product_revenue"),
        percent(F.col("revenue"), grand).alias("pct_revenue"),
        percent(F.col("upto_revenue"), grand).alias("cum_pct_revenue"),
    )


def revenue_by_variant(store: Store) -> DataFrame:
    lines = store.catalog_items("order_name", *LINE, "quantity", "price")
    return (
        line_sales(lines, store.paid_online("order_name"))
        .select(
            "sku",
            F.col("lineitem_name").alias("product_variant"),
            F.col("units").alias("units_sold"),
            dollars(F.col("revenue")).alias("revenue"),
        )
        .orderBy(
            F.col("revenue").desc_nulls_last(),
            F.col("product_variant").asc_nulls_last(),
            F.col("sku").asc_nulls_last(),
        )
    )


def revenue_by_state(store: Store) -> DataFrame:
    states = (
        store.paid_online("shipping_province", "subtotal")
        .groupBy(F.col("shipping_province").alias("state"))
        .agg(F.count("*").alias("orders"), F.sum("subtotal").alias("sales"))
    )
    return states.select(
        "state",
        "orders",
        money("sales").alias("revenue"),
        percent(F.col("sales"), total_of(states, "sales")).alias("pct_revenue"),
    ).orderBy(F.col("revenue").desc_nulls_last(), F.col("state").asc_nulls_last())
