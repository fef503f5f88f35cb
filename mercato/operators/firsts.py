"""First, last and repeat orders per customer. Customers are told apart by email."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators.joins import spread_join


def with_email(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("email").isNotNull())


def first_orders(orders: DataFrame, *keep: str) -> DataFrame:
    """Orders placed at each customer's first instant, with a copy count ``n``.

    Two orders at the same first instant are both first. Equal rows are counted
    before they meet. With further columns to ``keep``, one customer may have very many orders at
    the first instant; they are then joined to it, which adaptive execution
    can split. Without, there is one row for each instant, and Spark keeps only the leading
    rank per customer before it shuffles.
    """
    dated = with_email(orders).filter(F.col("created_at").isNotNull())
    distinct = dated.groupBy("email", "created_at", *keep).agg(F.count("*").alias("n"))
    if keep:
        first = dated.groupBy("email").agg(F.min("created_at").alias("__first"))
        met = spread_join(distinct, first, "email")
        return met.filter(F.col("created_at") == F.col("__first")).drop("__first")
    earliest = Window.partitionBy("email").orderBy("created_at")
    return distinct.withColumn("__r", F.rank().over(earliest)).filter("__r = 1").drop("__r")


def last_orders(orders: DataFrame) -> DataFrame:
    """Latest order instant per customer."""
    return with_email(orders).groupBy("email").agg(F.max("created_at").alias("last_order_at"))


def order_counts(orders: DataFrame) -> DataFrame:
    return with_email(orders).groupBy("email").agg(F.count("*").alias("orders"))


def repeat_customers(orders: DataFrame) -> DataFrame:
    """Emails with two orders or more."""
    return order_counts(orders).filter(F.col("orders") >= 2).select("email")
