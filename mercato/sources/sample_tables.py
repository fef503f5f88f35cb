"""Modeled tables derived from the star-schema sample tables.

Stands in for real exports: each table is an expression over customer, nation,
orders, part and lineitem. Only the joins a column needs are made.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.columns import MONEY
from mercato.store import Store

# The day after the last sample order.
AS_OF = dt.date(2001, 8, 2)


def _text(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


class SampleStore(Store):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__({})
        self._spark = spark
        self._folder = folder

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def table(self, name: str, *columns: str) -> DataFrame:
        df = getattr(self, f"_{name}")(set(columns))
        return df.select(*columns) if columns else df

    def _nation_of_customer(self) -> DataFrame:
        nation = self._read("nation").select("n_nationkey", "n_name")
        customer = self._read("customer").select("c_custkey", "c_nationkey")
        return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", "n_name"
        )

    def _customers(self, columns: set[str]) -> DataFrame:
        if not columns or "province_code" in columns:
            people = self._nation_of_customer()
        else:
            people = self._read("customer").select("c_custkey")
        finished = (
            self._read("orders")
            .filter(F.col("o_orderstatus") == "F")
            .groupBy("o_custkey")
            .agg(
                F.count("*").cast("int").alias("orders"),
                F.sum(F.col("o_totalprice").cast(MONEY)).alias("spent"),
            )
        )
        key = F.col("c_custkey")
        joined = people.join(finished, key == F.col("o_custkey"), "left")
        out = [
            key.alias("customer_id"),
            F.concat(F.lit("cust"), key.cast("string"), F.lit("@example.com")).alias("email"),
            (key % 3 != 0).alias("accepts_email_marketing"),
            (key % 4 == 0).alias("accepts_sms_marketing"),
            # A customer may hold a third of all orders: wider than an export's amount.
            F.coalesce("spent", F.lit(0)).cast("decimal(18,2)").alias("total_spent"),
            F.coalesce("orders", F.lit(0)).cast("int").alias("total_orders"),
        ]
        if "n_name" in people.columns:
            out.append(F.col("n_name").alias("province_code"))
        return joined.select(*out)

    def _orders(self, columns: set[str]) -> DataFrame:
        key = F.col("o_orderkey")
        even = key % 2 == 0
        status = F.col("o_orderstatus")
        priority = F.substring("o_orderpriority", 1, 1)
        created = F.expr(
            "cast(o_orderdate as timestamp_ntz)"
            " + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 86400)"
        )
        orders = self._read("orders")
        shipping = F.when(key % 4 == 0, F.lit("0.00")).otherwise(F.lit("7.95")).cast(MONEY)
        subtotal = F.col("o_totalprice").cast(MONEY)
        out = [
            _text("#", "o_orderkey").alias("order_name"),
            key.alias("order_id"),
            F.when(
                key % 97 != 0,
                F.concat(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("@example.com")),
            ).alias("email"),
            F.when((status == "F") | ((status == "O") & even), "paid")
            .when(status == "O", "partially_refunded")
            .when(status == "P", "pending")
            .alias("financial_status"),
            created.alias("created_at"),
            F.when(key % 41 == 0, created + F.expr("interval 1 day")).alias("cancelled_at"),
            F.when(priority == "1", "subscription_contract")
            .when(priority == "2", "web")
            .when((priority == "4") & even, "pos")
            .when(priority == "4", "iphone")
            .when(priority == "5", "shopify_draft_order")
            .alias("source"),
            subtotal.alias("subtotal"),
            shipping.alias("shipping"),
            (subtotal + shipping).cast(MONEY).alias("total"),
            F.when(key % 5 == 0, "WELCOME10").when(key % 5 == 1, "BREAD5").alias("discount_code"),
            F.when(key % 5 == 0, F.lit("10.00"))
            .when(key % 5 == 1, F.lit("5.00"))
            .otherwise(F.lit("0.00"))
            .cast(MONEY)
            .alias("discount_amount"),
            F.when(key % 23 == 0, F.lit("10.00"))
            .otherwise(F.lit("0.00"))
            .cast(MONEY)
            .alias("refunded_amount"),
            F.lpad((F.col("o_custkey") % 500).cast("string"), 5, "0").alias("shipping_zip"),
        ]
        if not columns or "shipping_province" in columns:
            orders = orders.join(
                self._nation_of_customer(), F.col("o_custkey") == F.col("c_custkey")
            )
            out.append(F.when(key % 101 != 0, F.col("n_name")).alias("shipping_province"))
        return orders.select(*out)

    def order_sizes(self) -> DataFrame:
        """(order_name, n): the lines of each order, whether or not their parts are known."""
        sizes = self._read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
        return sizes.filter("l_orderkey IS NOT NULL").select(_text("#", "l_orderkey").alias("order_name"), "n")

    def _part_titles(self) -> DataFrame:
        key = F.col("p_partkey")
        title = F.when(key % 13 == 0, F.substring_index("p_name", " ", 1)).otherwise(
            F.col("p_name")
        )
        return (
            self._read("part")
            .withColumn("title", title)
            .withColumn(
                "full_name",
                F.concat("title", F.lit(" - "), "p_brand", F.lit(" / "), "p_type"),
            )
            .withColumn("list_price", F.col("p_retailprice").cast(MONEY))
        )

    def _variants(self, columns: set[str]) -> DataFrame:
        key = F.col("p_partkey")
        price = F.col("list_price")
        return self._part_titles().select(
            F.replace("title", F.lit(" "), F.lit("-")).alias("handle"),
            F.col("title").alias("product_title"),
            F.col("full_name").alias("lineitem_name"),
            F.when(key % 5 != 0, _text("SKU-", "p_partkey")).alias("sku"),
            price.alias("price"),
            F.when(key % 2 != 0, (price * F.lit("0.4").cast("decimal(2,1)")).cast(MONEY)).alias(
                "cost_per_item"
            ),
            F.when(key % 17 == 0, "draft").otherwise("active").alias("status"),
        )

    def _products(self, columns: set[str]) -> DataFrame:
        return (
            self._variants(set())
            .groupBy("handle")
            .agg(
                F.max("product_title").alias("title"),
                F.count("price").alias("variant_count"),
                F.min("price").alias("min_price"),
                F.max("price").alias("max_price"),
            )
            .withColumn("product_category", F.concat(F.lit("Category "), F.upper("handle")))
        )

    def _order_items(self, columns: set[str]) -> DataFrame:
        key = F.col("l_partkey")
        title = F.col("title")
        lines = self._read("lineitem")
        dated = not columns or columns & {"email", "created_at"}
        if dated:
            # Before the texts of the parts make the lines wide.
            heads = self._orders({"order_id", "email", "created_at"}).select(
                F.col("order_id").alias("head_id"), "email", "created_at"
            )
            lines = lines.join(heads, F.col("l_orderkey") == F.col("head_id"))
        lines = lines.join(self._part_titles(), key == F.col("p_partkey"))
        out = [
            _text("#", "l_orderkey").alias("order_name"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.when(key % 29 == 0, "Tip")
            .when(key % 31 == 0, F.concat(F.lit("Legacy "), title))
            .when(key % 7 == 0, F.concat(title, F.lit(" (gift)")))
            .otherwise(F.col("full_name"))
            .alias("lineitem_name"),
            F.col("list_price").alias("price"),
            (F.col("l_discount") * 10).cast(MONEY).alias("discount"),
            F.when(
                (key % 29 == 0) | (key % 5 == 0) | ((key % 31 == 0) & (key % 11 != 0)),
                F.lit(None).cast("string"),
            )
            .when(key % 11 == 0, _text("OLD-", "l_partkey"))
            .otherwise(_text("SKU-", "l_partkey"))
            .alias("sku"),
        ]
        if dated:
            out += [F.col("email"), F.col("created_at")]
        return lines.select(*out)
