"""Export rows to typed tables.

Each table is a list of fields: the export header, how its text is read, and
the column it becomes. A column name is the header in snake case unless given.
A header the export lacks reads as NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.columns import (
    blank_to_null,
    export_bigint,
    export_int,
    export_money,
    export_timestamp,
    says,
    without_apostrophe,
)
from mercato.operators.joins import null_safe_join, spread_join
from mercato.store import Store

READERS: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: c,
    "lower": F.lower,
    "guarded": without_apostrophe,
    "blank": blank_to_null,
    "money": export_money,
    "int": export_int,
    "bigint": export_bigint,
    "guarded id": lambda c: export_bigint(without_apostrophe(c)),
    "double": lambda c: c.try_cast("double"),
    "yes": lambda c: says(c, "yes"),
    "true": lambda c: says(c, "true"),
    "time": export_timestamp,
}


def snake(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_")


@dataclass(frozen=True)
class Field:
    header: str
    reader: str = "text"
    name: str | None = None

    @property
    def column(self) -> str:
        return self.name or snake(self.header)


def _texts(*headers: str, prefix: str = "") -> list[Field]:
    return [Field(prefix + h) for h in headers]


# --- Fixed values: export headers -------------------------------------------

_ADDRESS = "Default Address "
CUSTOMER_FIELDS = [
    Field("Customer ID", "guarded id"),
    Field("First Name"),
    Field("Last Name"),
    Field("Email", "lower"),
    Field("Accepts Email Marketing", "yes"),
    Field("Accepts SMS Marketing", "yes"),
    Field("Accepts WhatsApp Marketing", "yes"),
    Field(_ADDRESS + "Company", name="company"),
    Field(_ADDRESS + "Address1", name="address1"),
    Field(_ADDRESS + "Address2", name="address2"),
    Field(_ADDRESS + "City", name="city"),
    Field(_ADDRESS + "Province Code", name="province_code"),
    Field(_ADDRESS + "Country Code", name="country_code"),
    Field(_ADDRESS + "Zip", "guarded", "zip"),
    Field(_ADDRESS + "Phone", "guarded", "address_phone"),
    Field("Phone", "guarded"),
    Field("Total Spent", "money"),
    Field("Total Orders", "int"),
    Field("Tax Exempt", "yes"),
    Field("Note"),
    Field("Tags"),
]


PLACE_PARTS = (
    "Name", "Street", "Address1", "Address2", "Company", "City", "Zip", "Province", "Province Name",
    "Country", "Phone",
)


def _place(kind: str) -> list[Field]:
    return [Field(f"{kind} {part}", "guarded" if part == "Zip" else "text") for part in PLACE_PARTS]


ORDER_FIELDS_BEFORE_COUNTS = [
    Field("Name", name="order_name"),
    Field("Id", "bigint", "order_id"),
    Field("Email", "lower"),
    Field("Financial Status"),
    Field("Fulfillment Status"),
    Field("Created at", "time"),
    Field("Paid at", "time"),
    Field("Fulfilled at", "time"),
    Field("Cancelled at", "time"),
    Field("Accepts Marketing", "yes"),
    Field("Currency"),
    Field("Subtotal", "money"),
    Field("Shipping", "money"),
    Field("Taxes", "money"),
    Field("Total", "money"),
    Field("Discount Code", "blank"),
    Field("Discount Amount", "money"),
    Field("Refunded Amount", "money"),
    Field("Outstanding Balance", "money"),
    Field("Shipping Method"),
]
ORDER_FIELDS_AFTER_COUNTS = [
    *_place("Billing"),
    *_place("Shipping"),
    Field("Notes"),
    Field("Note Attributes", "blank"),
    *_texts("Payment Method", "Payment Reference", "Payment ID", "Payment Terms Name"),
    Field("Next Payment Due At", "time"),
    *_texts("Payment References", "Employee", "Location", "Device ID"),
    Field("Tags", "blank"),
    *_texts("Risk Level", "Source"),
    *[
        field
        for i in range(1, 6)
        for field in (Field(f"Tax {i} Name"), Field(f"Tax {i} Value", "money"))
    ],
    *_texts("Phone", "Receipt Number"),
    Field("Duties", "money"),
]
ITEM_FIELDS = [
    Field("Name", name="order_name"),
    Field("Email", "lower"),
    Field("Created at", "time"),
    Field("Lineitem quantity", "int", "quantity"),
    Field("Lineitem name"),
    Field("Lineitem price", "money", "price"),
    Field("Lineitem compare at price", "money", "compare_at_price"),
    Field("Lineitem discount", "money", "discount"),
    Field("Lineitem sku", "blank", "sku"),
    Field("Lineitem requires shipping", "true", "requires_shipping"),
    Field("Lineitem taxable", "true", "taxable"),
    Field("Lineitem fulfillment status", name="fulfillment_status"),
    Field("Vendor"),
]
PRODUCT_FIELDS_BEFORE_COUNTS = [
    *_texts("Handle", "Title", "Vendor", "Product Category", "Type", "Tags"),
    Field("Published", "true"),
    Field("Status"),
]
_METAFIELD = "product.metafields.shopify."
PRODUCT_FIELDS_AFTER_COUNTS = [
    Field("Gift Card", "true"),
    *_texts("SEO Title", "SEO Description", "Image Src"),
    Field(
        "Product rating count (product.metafields.reviews.rating_count)", "int", "rating_count"
    ),
    Field(f"Allergen information ({_METAFIELD}allergen-information)", name="allergen_information"),
    Field(f"Bakery items included ({_METAFIELD}bakery-items-included)", name="bakery_items_included"),
    Field(f"Dietary preferences ({_METAFIELD}dietary-preferences)", name="dietary_preferences"),
    Field(f"Flavor ({_METAFIELD}flavor)", name="flavor"),
    Field(f"Flour/Grain type ({_METAFIELD}flour-grain-type)", name="flour_grain_type"),
    Field("Body (HTML)"),
]
VARIANT_FIELDS = [
    *_texts("Handle", "Option1 Value", "Option2 Value", "Option3 Value"),
    Field("Variant SKU", "blank", "sku"),
    Field("Variant Grams", "double", "grams"),
    Field("Variant Weight Unit", name="weight_unit"),
    Field("Variant Price", "money", "price"),
    Field("Variant Compare At Price", "money", "compare_at_price"),
    Field("Cost per item", "money"),
    Field("Variant Inventory Tracker", name="inventory_tracker"),
    Field("Variant Inventory Policy", name="inventory_policy"),
    Field("Variant Fulfillment Service", name="fulfillment_service"),
    Field("Variant Requires Shipping", "true", "requires_shipping"),
    Field("Variant Taxable", "true", "taxable"),
    Field("Variant Barcode", name="barcode"),
]
VARIANT_COLUMNS = (
    "handle", "product_title", "vendor", "status", "option1_name", "option1_value", "option2_name",
    "option2_value", "option3_name", "option3_value", "lineitem_name", "sku", "grams", "weight_unit",
    "price", "compare_at_price", "cost_per_item", "inventory_tracker", "inventory_policy",
    "fulfillment_service", "requires_shipping", "taxable", "barcode",
)
ITEM_COLUMNS = (
    "order_name", "order_id", "email", "created_at", "quantity", "lineitem_name", "price",
    "compare_at_price", "line_total", "discount", "sku", "requires_shipping", "taxable",
    "fulfillment_status", "vendor",
)
ORDER_HEADERS = [f.header for f in ORDER_FIELDS_BEFORE_COUNTS + ORDER_FIELDS_AFTER_COUNTS]
COUNTED_HEADERS = ["Name", "Lineitem quantity"]
ITEM_HEADERS = [f.header for f in ITEM_FIELDS]
ID_HEADERS = ["Name", "Id"]
NO_OPTION = "Default Title"
DEFAULT_STATUS = "active"

# -----------------------------------------------------------------------------


def text_of(raw: DataFrame, header: str) -> Column:
    if header in raw.columns:
        return F.col(f"`{header}`")
    return F.lit(None).cast("string")


def _read(raw: DataFrame, fields: list[Field]) -> list[Column]:
    return [READERS[f.reader](text_of(raw, f.header)).alias(f.column) for f in fields]


def _packed(raw: DataFrame, headers: list[str]) -> Column:
    """The text of some headers in one text: that of a JSON list, which tells missing fields from empty ones.

    JSON holds no invalid UTF-8: rows with such fields have them in hexadecimal, after an x.
    """
    texts = F.array(*[text_of(raw, h) for h in headers])
    in_hex = F.concat(F.lit("x"), F.to_json(F.transform(texts, F.hex)))
    return F.when(F.is_valid_utf8(F.concat_ws(",", texts)), F.to_json(texts)).otherwise(in_hex)


def _unpacked(df: DataFrame, packed: str, headers: list[str]) -> DataFrame:
    """The fields of ``packed`` under their headers, instead of it."""
    whole = {"mode": "FAILFAST", "maxStringLen": str((1 << 31) - 1)}
    others = [c for c in df.columns if c != packed]
    lists = F.from_json(F.ltrim(packed, F.lit("x")), "array<string>", whole)
    read = df.select(*others, F.startswith(packed, F.lit("x")).alias("__hex"), lists.alias("__texts"))
    bytes_of = F.transform("__texts", lambda text: F.unhex(text).cast("string"))
    fields = read.select(*others, F.when(F.col("__hex"), bytes_of).otherwise(F.col("__texts")).alias("__texts"))
    return fields.select(*others, *[F.get("__texts", F.lit(i)).alias(h) for i, h in enumerate(headers)])


def customers(raw: DataFrame) -> DataFrame:
    return raw.select(*_read(raw, CUSTOMER_FIELDS))


def order_items(raw: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Every export row is a line; the order id stands on one row per order.

    The id is summed up per order and joined back, so an order with very many
    lines is not gathered in one window. Rows without a name share one id.
    ``heads`` may be the same rows with fewer columns, ``ID_HEADERS``.
    """
    heads = raw if heads is None else heads
    lines = raw.select(*_read(raw, ITEM_FIELDS))
    name = text_of(heads, "Name").alias("order_name")
    ids = (
        heads.select(name, export_bigint(text_of(heads, "Id")).alias("order_id"))
        .filter(F.col("order_id").isNotNull())
        .groupBy("order_name")
        .agg(F.max("order_id").alias("order_id"))
    )
    total = F.col("quantity") * F.col("price") - F.coalesce("discount", F.lit(0))
    return (
        null_safe_join(lines, ids, ["order_name"], "left")
        .withColumn("line_total", total.cast("decimal(24,2)"))
        .select(*ITEM_COLUMNS)
    )


def orders(raw: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row per export row that carries a total, with counts over all its lines.

    The many fields meet their counts as one text, which is shorter than as columns, and are read after.
    ``lines`` may be the same rows with fewer columns, ``COUNTED_HEADERS``.
    """
    lines = raw if lines is None else lines
    fields = ORDER_FIELDS_BEFORE_COUNTS + ORDER_FIELDS_AFTER_COUNTS
    head = raw.filter(text_of(raw, "Total").isNotNull())
    heads = head.select(text_of(head, "Name").alias("order_name"), _packed(head, ORDER_HEADERS).alias("packed"))
    counts = lines.groupBy(text_of(lines, "Name").alias("order_name")).agg(
        F.count("*").alias("line_count"),
        F.sum(export_int(text_of(lines, "Lineitem quantity"))).alias("total_quantity"),
    )
    counted = _unpacked(spread_join(heads, counts, "order_name").drop("order_name"), "packed", ORDER_HEADERS)
    return counted.select(*_read(counted, fields), "line_count", "total_quantity").select(
        *[f.column for f in ORDER_FIELDS_BEFORE_COUNTS],
        "line_count",
        "total_quantity",
        *[f.column for f in ORDER_FIELDS_AFTER_COUNTS],
    )


def products(raw: DataFrame) -> DataFrame:
    """One row per export row that carries a title, with counts over its handle."""
    head = raw.filter(text_of(raw, "Title").isNotNull())
    heads = head.select(
        *_read(head, PRODUCT_FIELDS_BEFORE_COUNTS + PRODUCT_FIELDS_AFTER_COUNTS)
    ).withColumn("status", F.coalesce("status", F.lit(DEFAULT_STATUS)))
    price = export_money(text_of(raw, "Variant Price"))
    counts = raw.groupBy(text_of(raw, "Handle").alias("handle")).agg(
        F.count(text_of(raw, "Variant Price")).alias("variant_count"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.count(text_of(raw, "Image Src")).alias("image_count"),
    )
    return spread_join(heads, counts, "handle").select(
        *[f.column for f in PRODUCT_FIELDS_BEFORE_COUNTS],
        "variant_count",
        "min_price",
        "max_price",
        "image_count",
        *[f.column for f in PRODUCT_FIELDS_AFTER_COUNTS],
    )


def variants(raw: DataFrame) -> DataFrame:
    """One row per priced export row; product fields come from any priced row of the handle."""
    priced = raw.filter(text_of(raw, "Variant Price").isNotNull())
    own = priced.select(*_read(priced, VARIANT_FIELDS))
    shared = priced.groupBy(text_of(priced, "Handle").alias("handle")).agg(
        F.max(text_of(priced, "Title")).alias("product_title"),
        F.max(text_of(priced, "Vendor")).alias("vendor"),
        F.coalesce(F.max(text_of(priced, "Status")), F.lit(DEFAULT_STATUS)).alias("status"),
        *[F.max(text_of(priced, f"Option{i} Name")).alias(f"option{i}_name") for i in (1, 2, 3)],
    )
    option = F.col("option1_value")
    title = F.col("product_title")
    options = F.concat_ws(" / ", "option1_value", "option2_value", "option3_value")
    name = F.when(option.isNull() | (option == NO_OPTION), title).otherwise(
        F.concat(title, F.lit(" - "), options)
    )
    return (
        null_safe_join(own, shared, ["handle"], "left")
        .withColumn("lineitem_name", name)
        .withColumn("option1_value", F.nullif(option, F.lit(NO_OPTION)))
        .select(*VARIANT_COLUMNS)
    )


def model(raw: dict[str, DataFrame], read: Callable[[str, list[str]], DataFrame] | None = None) -> Store:
    """The five typed tables from the three raw ones.

    Where Spark cannot tell a reader which columns are needed, ``read`` gives some of a raw table.
    """

    def some(kind: str, headers: list[str]) -> DataFrame:
        return read(kind, headers) if read else raw[kind]

    return Store(
        {
            "customers": customers(raw["customers"]),
            "orders": orders(some("orders", ORDER_HEADERS), some("orders", COUNTED_HEADERS)),
            "order_items": order_items(some("orders", ITEM_HEADERS), some("orders", ID_HEADERS)),
            "products": products(raw["products"]),
            "variants": variants(raw["products"]),
        }
    )
