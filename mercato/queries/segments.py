"""Marketing consent and recency segments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import cents, days_between, money, percent, ratio, times
from mercato.operators.firsts import last_orders, with_email
from mercato.operators.histogram import in_chunks
from mercato.operators.joins import spread_join
from mercato.operators.ranking import Key, tiled_groups
from mercato.queries.concentration import SPEND_GROUPS, group_name
from mercato.queries.customer_base import midnight
from mercato.session import checkpoint
from mercato.store import Store

# The last group's name here, and the day limits of the segments.
CONSENT_GROUPS = (*SPEND_GROUPS[:4], "Bottom 20%")
ACTIVE_DAYS, AT_RISK_DAYS, DORMANT_DAYS = 30, 75, 125


def opt_in_rates(store: Store) -> DataFrame:
    customers = store.customers("accepts_email_marketing", "accepts_sms_marketing")
    email, sms = F.col("accepts_email_marketing"), F.col("accepts_sms_marketing")
    everyone = F.count("*")
    return customers.agg(
        everyone.alias("customers"),
        times(email).alias("email_opt_ins"),
        times(sms).alias("sms_opt_ins"),
        times(email & sms).alias("both_opt_ins"),
        percent(times(email), everyone).alias("email_pct"),
        percent(times(sms), everyone).alias("sms_pct"),
    )


def consent_by_spend(store: Store) -> DataFrame:
    """Opt-in rates by lifetime-spend quintile; ties are settled by customer id."""
    flags = ["accepts_email_marketing", "accepts_sms_marketing"]
    buyers = (
        store.customers("customer_id", "total_spent", "total_orders", *flags)
        .filter(F.col("total_orders") >= 1)
        .select("customer_id", cents("total_spent").alias("spend"), *flags)
    )
    groups = tiled_groups(
        checkpoint(buyers),
        5,
        {"tile": Key("spend", descending=True)},
        ties=[Key("customer_id"), *[Key(f) for f in flags]],
        by=flags,
    )
    in_group = F.sum("n")

    def opted_in(flag: str) -> Column:
        return percent(F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)), in_group)

    return (
        groups.groupBy("tile")
        .agg(
            in_group.alias("customers"),
            opted_in(flags[0]).alias("email_pct"),
            opted_in(flags[1]).alias("sms_pct"),
        )
        .orderBy("tile")
        .select(
            group_name(F.col("tile"), CONSENT_GROUPS).alias("ltv_group"),
            "customers",
            "email_pct",
            "sms_pct",
        )
    )


def never_bought(store: Store) -> DataFrame:
    customers = store.customers("total_orders", "accepts_email_marketing")
    idle = customers.filter((F.col("total_orders") == 0) & F.col("accepts_email_marketing"))
    return idle.agg(F.count("*").alias("subscribers_never_bought"))


def recency_segments(store: Store, as_of: dt.date) -> DataFrame:
    """Customers by days since their last online order.

    Customers are summed per email first, so the join is one row to one row;
    a customer without an email has no known order.
    """
    spent = F.col("total_spent")
    customers = (
        store.customers("email", "total_spent", "accepts_email_marketing")
        .groupBy("email")
        .agg(
            F.count("*").alias("n"),
            F.sum(spent).alias("spend"),
            F.count(spent).alias("spend_rows"),
            F.count_if("accepts_email_marketing").alias("opted_in"),
        )
    )
    last = last_orders(store.online_orders("email", "created_at"))
    days = days_between(F.col("last_order_at"), F.lit(as_of))
    # The labels.
    segment = (
        F.when(F.col("last_order_at").isNull(), "5 - Never Bought Online")
        .when(days <= ACTIVE_DAYS, "1 - Active (0-30d)")
        .when(days <= AT_RISK_DAYS, "2 - At Risk (31-75d)")
        .when(days <= DORMANT_DAYS, "3 - Dormant (76-125d)")
        .otherwise("4 - Lost (126d+)")
    )
    return (
        customers.join(last, "email", "left")
        .groupBy(segment.alias("segment"))
        .agg(
            F.sum("n").alias("customers"),
            money(F.sum("spend")).alias("total_spend"),
            ratio(F.sum("spend"), F.sum("spend_rows"), 2).alias("avg_spend"),
            percent(F.sum("opted_in"), F.sum("n")).alias("email_pct"),
        )
        .orderBy("segment")
    )


def segment_migration(store: Store, as_of: dt.date) -> DataFrame:
    """Recency at the start of the month against recency today."""
    month_start = as_of.replace(day=1)
    created = F.col("created_at")
    per_customer = (
        with_email(store.online_orders("email", "created_at"))
        .groupBy("email")
        .agg(
            F.max(created).alias("last"),
            F.max(F.when(created < midnight(month_start), created)).alias("last_before"),
        )
    )
    then = days_between(F.col("last_before"), F.lit(month_start))
    now = days_between(F.col("last"), F.lit(as_of))
    # The labels.
    start_segment = (
        F.when(F.col("last_before").isNull(), "Was New This Month")
        .when(then <= ACTIVE_DAYS, "Was Active")
        .when(then <= AT_RISK_DAYS, "Was At Risk")
        .otherwise("Was Dormant/Lost")
    )
    today_segment = (
        F.when(now <= ACTIVE_DAYS, "Now Active")
        .when(now <= AT_RISK_DAYS, "Now At Risk")
        .otherwise("Now Dormant/Lost")
    )
    return (
        per_customer.groupBy(
            start_segment.alias("start_segment"), today_segment.alias("today_segment")
        )
        .agg(F.count("*").alias("customers"))
        .orderBy("start_segment", "today_segment")
    )


def big_spenders_items(store: Store, more_than: int = 1000) -> DataFrame:
    """What each high-spending customer buys, in units."""
    customers = (
        store.customers("email", "total_spent")
        .filter(F.col("total_spent") > more_than)
        .groupBy("email", "total_spent")
        .agg(F.count("*").alias("profiles"))
    )
    lines = store.order_items("email", "lineitem_name", "quantity")
    return (
        spread_join(lines, customers, "email")
        .groupBy("email", "total_spent", "lineitem_name")
        .agg(F.sum(F.col("quantity") * F.col("profiles")).alias("units"))
        .select("email", money("total_spent").alias("total_spent"), "lineitem_name", "units")
        .orderBy(
            F.desc("total_spent"),
            F.col("units").desc_nulls_last(),
            "email",
            F.col("lineitem_name").asc_nulls_last(),
        )
    )


def daily_sales(store: Store) -> DataFrame:
    day = F.to_date("created_at").alias("day")
    return (
        store.orders("created_at", "total")
        .groupBy(day)
        .agg(
            F.count("*").alias("orders"),
            money(F.sum("total")).alias("revenue"),
            ratio(F.sum("total"), F.count("total"), 2).alias("avg_order_value"),
        )
        .orderBy(F.col("day").desc_nulls_last())
    )


def items_with_cost_and_category(store: Store) -> DataFrame:
    """Lines with catalog cost and category; a name held by two variants gives two rows.

    Variants meet their products first, and those alike in name, cost and category are counted: a line meets
    each kind once, and its rows are made after the last join.
    """
    lines = store.order_items("order_name", "quantity", "lineitem_name")
    variants = store.variants("lineitem_name", "cost_per_item", "handle")
    products = store.products("handle", "product_category")
    priced = spread_join(variants, products, "handle", "left")
    kinds = priced.groupBy("lineitem_name", "cost_per_item", "product_category").agg(F.count("*").alias("n"))
    found = lines.join(in_chunks(kinds), "lineitem_name", "left")
    # A line without a variant keeps its one row.
    rows = F.explode(F.sequence(F.lit(1), F.coalesce(F.col("n").cast("int"), F.lit(1))))
    return found.select(
        "order_name",
        "quantity",
        "lineitem_name",
        money("cost_per_item").alias("cost_per_item"),
        "product_category",
        rows.alias("row"),
    ).drop("row")
