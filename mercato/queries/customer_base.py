"""Who buys: new and returning customers, cohorts, reactivation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import (
    days_between,
    month_of,
    months_between_starts,
    percent,
    ratio,
    times,
    week_of,
)
from mercato.operators.firsts import first_orders, with_email
from mercato.operators.histogram import count_values, percentiles
from mercato.store import Store

# Fixed values, in days before the "as of" date.
REACTIVATION_WINDOW = 30
DORMANT_FROM = 150
DORMANT_LIMIT = 395


def midnight(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def new_vs_returning_weekly(store: Store) -> DataFrame:
    """Weekly orders by first-time and returning customers.

    Orders are counted per week without a join to each customer's first order:
    the first orders are counted separately and subtracted.
    """
    orders = store.online_orders("email", "created_at")
    week = week_of("created_at").alias("week")
    every = with_email(orders).groupBy(week).agg(
        F.count("*").alias("every"), F.count("created_at").alias("dated")
    )
    first = first_orders(orders).groupBy(week).agg(F.sum("n").alias("first"))
    weeks = (
        every.unionByName(first, allowMissingColumns=True)
        .groupBy("week")
        .agg(
            F.sum("every").alias("every"),
            F.sum("dated").alias("dated"),
            F.coalesce(F.sum("first"), F.lit(0)).alias("first"),
        )
    )
    returning = F.col("dated") - F.col("first")
    return weeks.select(
        "week",
        F.col("first").alias("first_time_orders"),
        returning.alias("returning_orders"),
        percent(returning, F.col("every")).alias("pct_returning"),
    ).orderBy(F.col("week").asc_nulls_last())


def repeat_purchase_rate(store: Store) -> DataFrame:
    buyers = store.customers("total_orders").filter(F.col("total_orders") >= 1)
    again = times(F.col("total_orders") >= 2)
    return buyers.agg(
        F.count("*").alias("customers_ever_bought"),
        again.alias("bought_2plus"),
        percent(again, F.count("*")).alias("repeat_rate_pct"),
    )


def acquisition_curve(store: Store) -> DataFrame:
    month = month_of("created_at")
    first_month = (
        with_email(store.online_orders("email", "created_at"))
        .groupBy("email")
        .agg(F.min(month).alias("acquisition_month"))
    )
    return (
        first_month.groupBy("acquisition_month")
        .agg(F.count("*").alias("new_customers"))
        .orderBy(F.col("acquisition_month").asc_nulls_last())
    )


def cohort_retention(store: Store) -> DataFrame:
    """Customers active in each month after their first, per first-order month.

    Orders are first reduced to one row per customer and month, so the
    per-customer window sees at most as many rows as there are months.
    """
    active = (
        with_email(store.online_orders("email", "created_at"))
        .select("email", month_of("created_at").alias("month"))
        .distinct()
    )
    cohort = F.min("month").over(Window.partitionBy("email")).alias("cohort_month")
    cells = (
        active.select("month", cohort)
        .filter(F.col("cohort_month").isNotNull())
        .groupBy(
            "cohort_month",
            months_between_starts(F.col("cohort_month"), F.col("month")).alias(
                "months_since_first"
            ),
        )
        .agg(F.count("*").alias("customers_active"))
    )
    # Everyone in a cohort is active in its month 0.
    size = F.max(F.when(F.col("months_since_first") == 0, F.col("customers_active"))).over(
        Window.partitionBy("cohort_month")
    )
    return (
        cells.withColumn("cohort_size", size)
        .select(
            "cohort_month",
            "cohort_size",
            "months_since_first",
            "customers_active",
            percent(F.col("customers_active"), F.col("cohort_size")).alias("retention_pct"),
        )
        .orderBy("cohort_month", F.col("months_since_first").asc_nulls_last())
    )


def time_to_second_purchase(store: Store) -> DataFrame:
    """Days between first and second order.

    Spark applies the "first two per customer" limit before the shuffle.
    """
    by_time = Window.partitionBy("email").orderBy(F.col("created_at").asc_nulls_last())
    first_two = (
        with_email(store.online_orders("email", "created_at"))
        .withColumn("nth", F.row_number().over(by_time))
        .filter(F.col("nth") <= 2)
    )
    pairs = (
        first_two.groupBy("email")
        .agg(
            F.count("*").alias("orders"),
            F.count("created_at").alias("dated"),
            F.min("created_at").alias("first_at"),
            F.max("created_at").alias("second_at"),
        )
        .filter(F.col("orders") == 2)
    )
    days = F.when(F.col("dated") == 2, days_between(F.col("first_at"), F.col("second_at")))
    stats = percentiles(count_values(pairs, days), [25, 50, 75])
    return stats.select(
        F.col("rows").alias("repeat_customers"),
        ratio(F.col("total"), F.col("present"), 1).alias("avg_days"),
        (F.col("p50") / 100.0).alias("median_days"),
        (F.col("p25") / 100.0).alias("p25_days"),
        (F.col("p75") / 100.0).alias("p75_days"),
    )


def reactivation_rate(store: Store, as_of: dt.date) -> DataFrame:
    """Of the customers dormant when the window opened, how many ordered in it."""
    window_start = midnight(as_of - dt.timedelta(days=REACTIVATION_WINDOW))
    created = F.col("created_at")
    per_customer = (
        with_email(store.online_orders("email", "created_at"))
        .groupBy("email")
        .agg(
            F.max(F.when(created < window_start, created)).alias("last_before"),
            F.max(created).alias("last"),
        )
    )
    dormant = per_customer.filter(
        (F.col("last_before") < midnight(as_of - dt.timedelta(days=DORMANT_FROM)))
        & (F.col("last_before") >= midnight(as_of - dt.timedelta(days=DORMANT_LIMIT)))
    )
    back = times(F.col("last") >= window_start)
    return dormant.agg(
        F.count("*").alias("dormant"),
        back.alias("reactivated"),
        percent(back, F.count("*")).alias("reactivation_pct"),
    )
