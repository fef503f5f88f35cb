"""Orders by discount, shipping, refund, channel and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import (
    SUBSCRIPTION_PREFIX,
    money,
    month_of,
    percent,
    ratio,
    round_away,
    times,
)
from mercato.queries.concentration import total_of
from mercato.operators.sketches import united
from mercato.store import Store

TOP_ZIPS = 20


def _average(column: str, digits: int = 2):
    """Average of a decimal: exact sum, one division."""
    return ratio(F.sum(column), F.count(column), digits)


def discount_code_usage(store: Store) -> DataFrame:
    paid = store.paid_online("discount_code", "subtotal", "discount_amount")
    return (
        paid.groupBy("discount_code")
        .agg(
            F.count("*").alias("orders"),
            money(F.sum("subtotal")).alias("revenue"),
            money(F.sum("discount_amount")).alias("discount"),
            _average("subtotal").alias("avg_order_value"),
        )
        .withColumn("discount_code", F.coalesce("discount_code", F.lit("(none)")))
        .orderBy(F.desc("orders"), "discount_code")
    )


def discount_depth(store: Store) -> DataFrame:
    """Discount as a share of the undiscounted order value."""
    paid = store.paid_online("discount_code", "subtotal", "discount_amount")
    usage = F.when(F.col("discount_code").isNull(), "No Discount Code").otherwise(
        "Used a Discount Code"
    )
    full = F.col("subtotal") + F.col("discount_amount")
    average_discount = F.try_divide(
        F.sum("discount_amount").cast("double"), F.count("discount_amount").cast("double")
    )
    average_full = F.try_divide(F.sum(full).cast("double"), F.count(full).cast("double"))
    return (
        paid.groupBy(usage.alias("discount_usage"))
        .agg(
            F.count("*").alias("orders"),
            _average("subtotal").alias("avg_order_value"),
            round_away(average_discount, 2).alias("avg_discount"),
            percent(average_discount, average_full).alias("depth_pct"),
        )
        .orderBy("discount_usage")
    )


def shipping_monthly(store: Store) -> DataFrame:
    paid = store.paid_online("created_at", "shipping")
    free = times(F.col("shipping") == 0)
    return (
        paid.groupBy(month_of("created_at").alias("month"))
        .agg(
            F.count("*").alias("paid_orders"),
            money(F.sum("shipping")).alias("shipping_charged"),
            _average("shipping").alias("avg_shipping"),
            free.alias("free_orders"),
            percent(free, F.count("*")).alias("pct_free"),
        )
        .orderBy(F.col("month").asc_nulls_last())
    )


def refunds(store: Store) -> DataFrame:
    online = store.online_orders("refunded_amount", "total")
    refunded = times(F.col("refunded_amount") > 0)
    return online.agg(
        F.count("*").alias("orders"),
        refunded.alias("refunded_orders"),
        percent(refunded, F.count("*"), 2).alias("refund_rate_pct"),
        money(F.sum("refunded_amount")).alias("total_refunded"),
        percent(F.sum("refunded_amount"), F.sum("total"), 2).alias("pct_revenue_refunded"),
    )


def channel_mix(store: Store) -> DataFrame:
    source = F.col("source")
    # Source names.
    channel = (
        F.when(source.startswith(SUBSCRIPTION_PREFIX), "Subscription")
        .when(source == "web", "One-Time Web")
        .when(source == "shopify_draft_order", "Draft Order (Manual)")
        .otherwise("Other Channel")
    )
    channels = (
        store.paid_online("source", "subtotal")
        .groupBy(channel.alias("channel"))
        .agg(
            F.count("*").alias("orders"),
            F.sum("subtotal").alias("sales"),
            _average("subtotal").alias("avg_order_value"),
        )
    )
    return channels.select(
        "channel",
        "orders",
        money("sales").alias("revenue"),
        "avg_order_value",
        percent(F.col("sales"), total_of(channels, "sales")).alias("pct_revenue"),
    ).orderBy(F.col("revenue").desc_nulls_last(), "channel")


def state_scorecard(store: Store, approximate: bool = False) -> DataFrame:
    """Revenue and repeat customers per state.

    ``approximate`` estimates both kinds of customers from the store's daily sketches.

    Customers, orders and revenue count paid orders; repeat customers may have
    any status. One pass reduces orders to (state, customer); a customer's
    total over states then needs a window of at most as many rows as states.
    """
    if approximate:
        days = store.place_days().withColumnRenamed("shipping_province", "state").filter(F.col("state").isNotNull())
        return _scorecard(united(days, ["state"], ["orders", "sales"], ["customers", "repeat_customers"]))
    orders = store.online_orders("shipping_province", "email", "financial_status", "subtotal")
    paid = F.col("financial_status") == "paid"
    pairs = orders.groupBy(F.col("shipping_province").alias("state"), "email").agg(
        F.count("*").alias("all_orders"),
        F.count_if(paid).alias("orders"),
        F.sum(F.when(paid, F.col("subtotal"))).alias("sales"),
    )
    everywhere = F.sum("all_orders").over(Window.partitionBy("email"))
    known = F.col("email").isNotNull()
    states = (
        pairs.withColumn("customer_orders", everywhere)
        .filter(F.col("state").isNotNull())
        .groupBy("state")
        .agg(
            times(known & (F.col("orders") > 0)).alias("customers"),
            F.sum("orders").alias("orders"),
            F.sum("sales").alias("sales"),
            times(known & (F.col("customer_orders") >= 2)).alias("repeat_customers"),
        )
    )
    return _scorecard(states)


def _scorecard(states: DataFrame) -> DataFrame:
    return states.filter(F.col("orders") > 0).select(
        "state",
        "customers",
        "orders",
        money("sales").alias("revenue"),
        ratio(F.col("sales"), F.col("orders"), 2).alias("avg_order_value"),
        "repeat_customers",
        percent(F.col("repeat_customers"), F.col("customers")).alias("repeat_pct"),
    ).orderBy(F.col("revenue").desc_nulls_last(), "state")


def top_zips(store: Store, approximate: bool = False) -> DataFrame:
    """Sales by zip code. ``approximate`` estimates the customers from the store's daily sketches."""
    places = ["shipping_zip", "shipping_province"]
    if approximate:
        zips = united(store.place_days(), places, ["orders", "sales"], ["customers"])
        zips = zips.filter(F.col("orders") > 0).withColumnRenamed("customers", "unique_customers")
    else:
        paid = store.paid_online(*places, "email", "subtotal")
        zips = paid.groupBy(*places).agg(
            F.count("*").alias("orders"),
            F.count_distinct("email").alias("unique_customers"),
            F.sum("subtotal").alias("sales"),
        )
    return (
        zips.withColumnsRenamed({"shipping_zip": "zip_code", "shipping_province": "state"})
        .orderBy(
            F.col("sales").desc_nulls_last(),
            F.col("zip_code").asc_nulls_last(),
            F.col("state").asc_nulls_last(),
        )
        .limit(TOP_ZIPS)
        .select("zip_code", "state", "orders", "unique_customers", money("sales").alias("revenue"))
    )
