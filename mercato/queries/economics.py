"""What customers are worth: order value, lifetime value, frequency, RFM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import (
    SUBSCRIPTION_PREFIX,
    cents,
    days_between,
    dollars,
    hundredths_rounded,
    month_of,
    ratio,
    round_away,
)
from mercato.operators.firsts import first_orders, last_orders, with_email
from mercato.operators.histogram import count_values, percentiles
from mercato.operators.joins import spread_join
from mercato.operators.ranking import Key, tiled_groups
from mercato.session import checkpoint
from mercato.operators.sketches import approximate_percentiles
from mercato.store import Store


def _average_dollars(total_cents, rows):
    return ratio(dollars(total_cents), rows, 2)


def _buyers(store: Store, *columns: str) -> DataFrame:
    wanted = dict.fromkeys((*columns, "total_orders"))
    return store.customers(*wanted).filter(F.col("total_orders") >= 1).select(*columns)


def average_order_value(store: Store) -> DataFrame:
    paid = store.paid_online("subtotal", "total", "cancelled_at")
    kept = paid.filter(F.col("cancelled_at").isNull())
    counts = count_values(
        kept,
        cents("subtotal"),
        sums={
            "total_cents": cents("total"),
            "total_rows": F.col("total").isNotNull().cast("bigint"),
        },
    )
    stats = percentiles(counts, [50], sums=["total_cents", "total_rows"])
    return stats.select(
        F.col("rows").alias("n"),
        _average_dollars(F.col("total"), F.col("present")).alias("avg_subtotal"),
        _average_dollars(F.col("total_cents"), F.col("total_rows")).alias("avg_total"),
        hundredths_rounded(F.col("p50")).alias("median_subtotal"),
    )


def average_order_value_monthly(store: Store) -> DataFrame:
    """Cancelled orders count here, unlike in ``average_order_value``."""
    paid = store.paid_online("created_at", "subtotal").withColumn("month", month_of("created_at"))
    stats = percentiles(count_values(paid, cents("subtotal"), ["month"]), [50], ["month"])
    return stats.select(
        "month",
        F.col("rows").alias("paid_orders"),
        _average_dollars(F.col("total"), F.col("present")).alias("avg_order_value"),
        hundredths_rounded(F.col("p50")).alias("median_order_value"),
    ).orderBy(F.col("month").asc_nulls_last())


def order_value_new_vs_returning(store: Store) -> DataFrame:
    """Order value of first orders and of later ones.

    Value counts of later orders are those of all orders less those of first
    orders, so no order is joined to its customer's history. The first order
    may have any status; only paid ones are valued.
    """
    orders = store.online_orders("email", "created_at", "financial_status", "subtotal")
    is_paid = F.col("financial_status") == "paid"
    columns = orders.select("email", "created_at", is_paid.alias("paid"), "subtotal")
    value = cents("subtotal").alias("value")

    paid = with_email(columns).filter("paid").groupBy(value).agg(F.count("*").alias("n"))
    first = (
        first_orders(columns, "paid", "subtotal")
        .filter("paid")
        .groupBy(value)
        .agg(F.sum("n").alias("n"))
    )
    kind = F.lit("Repeat Customer").alias("customer_type")
    counts = (
        paid.select(kind, "value", "n")
        .unionByName(first.select(kind, "value", (-F.col("n")).alias("n")))
        .unionByName(first.select(F.lit("First-Time Buyer").alias("customer_type"), "value", "n"))
        .groupBy("customer_type", "value")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > 0)
    )
    stats = percentiles(counts, [50], ["customer_type"])
    return stats.select(
        "customer_type",
        F.col("rows").alias("orders"),
        _average_dollars(F.col("total"), F.col("present")).alias("avg_order_value"),
        hundredths_rounded(F.col("p50")).alias("median_order_value"),
    ).orderBy("customer_type")


def lifetime_value_distribution(store: Store, approximate: bool = False) -> DataFrame:
    """Percentiles of spend. ``approximate`` takes values of about the right rank, in one aggregate."""
    buyers, percents = _buyers(store, "total_spent"), [50, 75, 90, 95, 100]
    if approximate:
        stats = approximate_percentiles(buyers, cents("total_spent"), percents)
    else:
        stats = percentiles(count_values(buyers, cents("total_spent")), percents)
    return stats.select(
        F.col("rows").alias("customers"),
        _average_dollars(F.col("total"), F.col("present")).alias("avg_spend"),
        hundredths_rounded(F.col("p50")).alias("median_spend"),
        hundredths_rounded(F.col("p75")).alias("p75_spend"),
        hundredths_rounded(F.col("p90")).alias("p90_spend"),
        hundredths_rounded(F.col("p95")).alias("p95_spend"),
        hundredths_rounded(F.col("p100")).alias("max_spend"),
    )


def purchase_frequency(store: Store) -> DataFrame:
    spans = (
        with_email(store.online_orders("email", "created_at"))
        .groupBy("email")
        .agg(
            F.count("*").alias("orders"),
            days_between(F.min("created_at"), F.max("created_at")).alias("days"),
        )
        .filter(F.col("orders") >= 2)
    )
    # A span of zero days has no yearly rate and is left out of that average.
    yearly = F.try_divide(F.lit(365.0) * F.col("orders"), F.col("days").cast("double"))
    gap = F.try_divide(F.col("days").cast("double"), (F.col("orders") - 1).cast("double"))
    return spans.agg(
        F.count("*").alias("repeat_customers"),
        ratio(F.sum("orders"), F.count("orders"), 2).alias("avg_orders"),
        round_away(F.avg(yearly), 2).alias("orders_per_year"),
        round_away(F.avg(gap), 1).alias("avg_days_between"),
    )


def rfm_segments(store: Store, as_of: dt.date) -> DataFrame:
    """Quintile scores for recency, frequency and spend.

    Ties in a score are settled by email.
    """
    customers = _buyers(store, "email", "total_orders", "total_spent").select(
        "email",
        F.col("total_orders").cast("bigint").alias("frequency"),
        cents("total_spent").alias("spend"),
    )
    recency = days_between(F.col("last_order_at"), F.lit(as_of))
    scored = spread_join(
        customers.filter(F.col("email").isNotNull()),
        last_orders(store.online_orders("email", "created_at")),
        "email",
    ).select("email", "frequency", "spend", recency.alias("recency"))
    groups = tiled_groups(
        checkpoint(scored),
        5,
        {
            "r_score": Key("recency", descending=True),
            "f_score": Key("frequency"),
            "m_score": Key("spend"),
        },
        ties=[Key("email"), Key("frequency"), Key("spend")],
        sums=["spend"],
    )
    return groups.select(
        "r_score",
        "f_score",
        "m_score",
        F.col("n").alias("customers"),
        _average_dollars(F.col("spend"), F.col("spend_rows")).alias("avg_spend"),
    ).orderBy(F.desc("r_score"), F.desc("f_score"), F.desc("m_score"))


def subscriber_lifetime_value(store: Store) -> DataFrame:
    """Lifetime spend of customers who ever subscribed and of those who never did."""
    subscribed = F.col("source").startswith(SUBSCRIPTION_PREFIX)
    kinds = (
        with_email(store.online_orders("email", "source"))
        .groupBy("email")
        .agg(F.max(F.coalesce(subscribed, F.lit(False))).alias("subscribed"))
    )
    # Customers who share an email and a spend are counted before the join.
    spend = (
        with_email(store.customers("email", "total_spent", "total_orders"))
        .groupBy("email", cents("total_spent").alias("value"))
        .agg(
            F.count("*").alias("n"),
            F.sum("total_orders").alias("order_sum"),
            F.count("total_orders").alias("order_rows"),
        )
    )
    # The labels.
    kind = F.when(F.col("subscribed"), "Has Subscribed").otherwise("One-Time Only")
    counts = (
        spread_join(spend, kinds, "email")
        .groupBy(kind.alias("customer_type"), "value")
        .agg(*[F.sum(c).alias(c) for c in ("n", "order_sum", "order_rows")])
    )
    stats = percentiles(counts, [50], ["customer_type"], ["order_sum", "order_rows"])
    return stats.select(
        "customer_type",
        F.col("rows").alias("customers"),
        _average_dollars(F.col("total"), F.col("present")).alias("avg_spend"),
        hundredths_rounded(F.col("p50")).alias("median_spend"),
        ratio(F.col("order_sum"), F.col("order_rows"), 2).alias("avg_orders"),
    ).orderBy("customer_type")


def channel_crossover(store: Store) -> DataFrame:
    """How many customers buy on the web, by subscription, or both."""
    web = F.count_if(F.col("source") == "web")
    subscription = F.count_if(F.col("source").startswith(SUBSCRIPTION_PREFIX))
    per_customer = (
        with_email(store.online_orders("email", "source"))
        .groupBy("email")
        .agg((web > 0).alias("web"), (subscription > 0).alias("subscription"))
    )
    # The labels.
    pattern = (
        F.when(F.col("web") & F.col("subscription"), "Both Web & Subscription")
        .when(F.col("subscription"), "Subscription Only")
        .when(F.col("web"), "One-Time Web Only")
        .otherwise("Other Channels Only")
    )
    return (
        per_customer.groupBy(pattern.alias("pattern"))
        .agg(F.count("*").alias("customers"))
        .orderBy(F.desc("customers"), "pattern")
    )
