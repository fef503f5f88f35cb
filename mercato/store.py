"""The five modeled tables and the two derived views, as the queries see them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import cents
from mercato.operators.baskets import number_products
from mercato.operators.firsts import repeat_customers
from mercato.operators.joins import spread_join
from mercato.operators.sketches import distinct_sketch
from mercato.operators.match import LINE, line_matches, with_match

TABLES = ("customers", "orders", "order_items", "products", "variants")
LINE_MATCHES = "line_matches"
#: The lines with what they match, and the numbers of the catalog's line names.
MATCHED_ITEMS = "matched_items"
PRODUCT_NAMES = "product_names"
#: Daily rollups with sketches of the customers.
PRODUCT_DAYS = "product_days"
PLACE_DAYS = "place_days"
#: What a matched line knows of the catalog; all but the first are null without a match.
MATCH_COLUMNS = ("in_catalog", "product_title", "cost_per_item", "product")

# Order sources that are walk-in sales, not online ones.
IN_PERSON_SOURCES = ("pos", "iphone")


def online_only(orders: DataFrame) -> DataFrame:
    """Orders that are not point-of-sale; an unknown source counts as online."""
    source = F.col("source")
    return orders.filter(source.isNull() | ~source.isin(*IN_PERSON_SOURCES))


class Store:
    """Named modeled tables; queries ask for the columns they need."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self._tables = dict(tables)

    def table(self, name: str, *columns: str) -> DataFrame:
        df = self._tables[name]
        return df.select(*columns) if columns else df

    def customers(self, *columns: str) -> DataFrame:
        return self.table("customers", *columns)

    def orders(self, *columns: str) -> DataFrame:
        return self.table("orders", *columns)

    def order_items(self, *columns: str) -> DataFrame:
        return self.table("order_items", *columns)

    def products(self, *columns: str) -> DataFrame:
        return self.table("products", *columns)

    def variants(self, *columns: str) -> DataFrame:
        return self.table("variants", *columns)

    def online_orders(self, *columns: str) -> DataFrame:
        wanted = dict.fromkeys((*columns, "source")) if columns else ()
        online = online_only(self.orders(*wanted))
        return online.select(*columns) if columns else online

    def paid_online(self, *columns: str) -> DataFrame:
        wanted = dict.fromkeys((*columns, "financial_status"))
        paid = self.online_orders(*wanted).filter(F.col("financial_status") == "paid")
        return paid.select(*columns)

    def line_matches(self) -> DataFrame:
        """Catalog match per distinct (sku, lineitem_name): stored, or worked out now."""
        if LINE_MATCHES in self._tables:
            return self._tables[LINE_MATCHES]
        variants = self.variants("sku", "lineitem_name", "product_title", "cost_per_item")
        return line_matches(self.order_items(*LINE), variants)

    def product_names(self) -> DataFrame:
        """(product, lineitem_name): a number for each line name in the catalog, stored or given now."""
        if PRODUCT_NAMES in self._tables:
            return self._tables[PRODUCT_NAMES]
        names = self.line_matches().filter("in_catalog").select("lineitem_name").dropna().distinct()
        self._tables[PRODUCT_NAMES] = number_products(names)
        return self._tables[PRODUCT_NAMES]

    def matched_items(self, *columns: str) -> DataFrame:
        """Lines with ``MATCH_COLUMNS``: stored on each line, or joined now."""
        if MATCHED_ITEMS in self._tables:
            return self.table(MATCHED_ITEMS, *columns)
        wanted = dict.fromkeys((*[c for c in columns if c not in MATCH_COLUMNS], *LINE)) if columns else ()
        names = self.product_names() if not columns or "product" in columns else None
        found = with_match(self.order_items(*wanted), self.line_matches(), names)
        return found.select(*columns) if columns else found

    def catalog_items(self, *columns: str) -> DataFrame:
        wanted = columns or self.order_items().columns
        return self.matched_items(*dict.fromkeys((*wanted, "in_catalog"))).filter("in_catalog").select(*wanted)

    def product_days(self) -> DataFrame:
        """Paid online sales of catalog lines by line name and day: ``units``, ``cents`` and a sketch of ``buyers``."""
        if PRODUCT_DAYS in self._tables:
            return self._tables[PRODUCT_DAYS]
        lines = self.catalog_items("order_name", "lineitem_name", "quantity", "price")
        sold = spread_join(lines, self.paid_online("order_name", "email", "created_at"), "order_name")
        return sold.groupBy("lineitem_name", F.to_date("created_at").alias("day")).agg(
            F.sum("quantity").alias("units"),
            F.sum(F.col("quantity") * cents("price")).alias("cents"),
            distinct_sketch(F.col("email")).alias("buyers"),
        )

    def place_days(self) -> DataFrame:
        """Online orders by state, zip code and day: paid ``orders``, their ``sales``, and sketches of customers.

        ``customers`` have a paid order there on that day, ``repeat_customers`` any order, and two anywhere.
        """
        if PLACE_DAYS in self._tables:
            return self._tables[PLACE_DAYS]
        places = ("shipping_province", "shipping_zip")
        orders = self.online_orders(*places, "email", "created_at", "financial_status", "subtotal")
        again = repeat_customers(orders).withColumn("again", F.lit(True))
        known = spread_join(orders, again, "email", "left")
        paid = F.col("financial_status") == "paid"
        return known.groupBy(*places, F.to_date("created_at").alias("day")).agg(
            F.count_if(paid).alias("orders"),
            F.sum(F.when(paid, F.col("subtotal"))).alias("sales"),
            distinct_sketch(F.when(paid, F.col("email"))).alias("customers"),
            distinct_sketch(F.when(F.col("again"), F.col("email"))).alias("repeat_customers"),
        )
