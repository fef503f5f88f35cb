"""Export-shaped text rows derived from the sample tables.

They hold the same data as ``SampleStore`` in the form a store admin exports
it: ids and zips behind an apostrophe, yes/no flags, times with an offset,
order fields on one row per order, product fields on one row per product.
Fields that the sample tables lack are filled from a number of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.columns import clock_text
from mercato.operators.histogram import one_row_each
from mercato.operators.joins import null_safe_join, spread_join
from mercato.plans.model import (
    CUSTOMER_FIELDS,
    ITEM_FIELDS,
    ORDER_FIELDS_AFTER_COUNTS,
    ORDER_FIELDS_BEFORE_COUNTS,
    PRODUCT_FIELDS_AFTER_COUNTS,
    PRODUCT_FIELDS_BEFORE_COUNTS,
    VARIANT_FIELDS,
    Field,
)
from mercato.sources.sample_tables import SampleStore

ORDER_HEADERS = {
    "Financial Status": "financial_status",
    "Subtotal": "subtotal",
    "Shipping": "shipping",
    "Total": "total",
    "Discount Code": "discount_code",
    "Discount Amount": "discount_amount",
    "Refunded Amount": "refunded_amount",
    "Shipping Province": "shipping_province",
    "Source": "source",
}


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _guarded(c: str) -> Column:
    return F.concat(F.lit("'"), _text(c))


def _word(c: str, yes: str, no: str) -> Column:
    return F.when(F.col(c), yes).otherwise(no)


def _time(c: str) -> Column:
    return F.concat(clock_text(c), F.lit(" -0400"))


def _filler(field: Field, key: Column) -> Column:
    """Export text for a field that the sample tables lack, derived from a number.

    Some are missing or blank, some hold quotes and line breaks, some times are
    no times, and flags take both values.
    """
    number = key.cast("string")
    if field.reader in ("yes", "true"):
        on, off = ("yes", "no") if field.reader == "yes" else ("true", "false")
        value = F.when(key % 5 != 0, F.when(key % 2 == 0, on).otherwise(off))
    elif field.reader == "money":
        value = F.when(key % 7 != 0, F.concat((key % 1000).cast("string"), F.lit(".25")))
    elif field.reader == "int":
        value = (key % 100).cast("string")
    elif field.reader == "double":
        value = F.concat(number, F.lit(".5"))
    elif field.reader == "time":
        day = F.lpad((key % 28 + 1).cast("string"), 2, "0")
        value = F.when(key % 11 == 0, F.lit("no time")).otherwise(
            F.concat(F.lit("2024-03-"), day, F.lit(" 10:20:30 -0400"))
        )
    else:
        text = F.when(key % 5 == 1, F.concat(F.lit(f'{field.column} "q",\n'), number)).otherwise(
            F.concat(F.lit(f"{field.column} "), number)
        )
        if field.reader == "guarded":
            text = F.concat(F.lit("'"), text)
        value = F.when(key % 3 != 0, text).otherwise("" if field.reader == "blank" else None)
    return F.when(key.isNotNull(), value).alias(field.header)


def _filled(df: DataFrame, fields: list[Field], key: Column, *but: str) -> list[Column]:
    """Fillers for the fields whose header ``df`` does not have yet."""
    present = {*df.columns, *but}
    return [_filler(f, key) for f in fields if f.header not in present]


def raw_customers(store: SampleStore) -> DataFrame:
    own = store.customers().select(
        "customer_id",
        _guarded("customer_id").alias("Customer ID"),
        F.concat(F.lit("Customer "), _text("customer_id")).alias("First Name"),
        F.upper("email").alias("Email"),
        _word("accepts_email_marketing", "yes", "no").alias("Accepts Email Marketing"),
        _word("accepts_sms_marketing", "yes", "no").alias("Accepts SMS Marketing"),
        F.col("province_code").alias("Default Address Province Code"),
        F.concat(F.lit("'"), F.lpad((F.col("customer_id") % 500).cast("string"), 5, "0")).alias(
            "Default Address Zip"
        ),
        _text("total_spent").alias("Total Spent"),
        _text("total_orders").alias("Total Orders"),
    )
    return own.select("*", *_filled(own, CUSTOMER_FIELDS, F.col("customer_id"))).drop("customer_id")


#: Rows of a key that one task sorts; keys with more are counted over many tasks.
MANY = 100_000


def _counted_lead(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Flag the first row per key as ``leads``, for keys of very many rows.

    Equal rows are counted, the first one per key is a minimum, and the
    counts are expanded again, so no key is gathered in one task.
    """
    counted = rows.groupBy(key, *order).agg(F.count("*").alias("n"))
    body = F.struct(*[F.col(c) for c in order])
    first = counted.groupBy(key).agg(F.min(body).alias("first"))
    marked = spread_join(counted, first, key).withColumn("leads", body == F.col("first"))
    each = one_row_each(marked, [key, *order]).drop("n", "first")
    return each.withColumn("leads", F.col("leads") & (F.col("i") == 0)).drop("i")


def _with_one_lead(
    rows: DataFrame, key: str, order: list[str], sizes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flag one row per key as ``leads``: the first in the given order.

    The first result has the keys of up to ``MANY`` rows, whose rows move once, to be sorted by key; the
    second has the others, and the third names them: rows / ``MANY`` keys at most. ``sizes`` has the rows of
    each key as ``n``; they need not be exact, as both ways flag alike.
    """
    rows = rows.filter(F.col(key).isNotNull())
    if sizes is None:
        sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    many = F.broadcast(sizes.filter(F.col("n") > MANY).select(key))
    # Not a row number: where only leading rows are asked for, Spark would drop the others before it moves
    # them, and no longer see that another step moves the same rows.
    earlier = F.lag(F.lit(True)).over(Window.partitionBy(key).orderBy(*order))
    few = rows.join(many, key, "left_anti").select(key, *order, earlier.isNull().alias("leads"))
    return few, _counted_lead(rows.join(many, key, "left_semi"), key, order), many


def _with_heads(rows: DataFrame, heads: DataFrame, many: bool) -> DataFrame:
    """Lines with their order's email and time, and on leading lines its other fields.

    Lines of few to an order are sorted by order already, stay where they are, and meet the fields in one
    join; ``many`` are dealt out anew for each of two joins, which can then split an order. An order that
    comes more than once gives each of its times with each of its fields.
    """
    everywhere = ["order_name", "email", "created_at"]
    if many:
        only_first = heads.drop("email", "created_at").withColumn("leads", F.lit(True))
        # Sizes are not estimated through an explode: never broadcast the rows.
        full = rows.hint("merge").join(heads.select(*everywhere), "order_name")
        return null_safe_join(full, only_first, ["order_name", "leads"], "left")
    # As one column: steps that need few of the fields then move the same rows as those that need all.
    own = heads.filter(F.col("order_name").isNotNull()).select("order_name", F.struct(*heads.columns).alias("own"))
    own = own.select("*", F.collect_list("own").over(Window.partitionBy("order_name")).alias("every"))
    first = F.explode_outer(F.when(F.col("leads"), F.col("every"))).alias("first")
    full = rows.hint("merge").join(own, "order_name").select(*rows.columns, "own.email", "own.created_at", first)
    return full.select("*", *[F.col(f"first.{c}") for c in heads.columns if c not in everywhere]).drop("first")


def raw_orders(store: SampleStore) -> DataFrame:
    """One row per line; the first line of an order in sort order carries its fields."""
    line = ["lineitem_name", "sku", "quantity", "price", "discount"]
    few, hot, many = _with_one_lead(store.order_items("order_name", *line), "order_name", line, store.order_sizes())
    heads = store.orders()
    hot_heads = heads.join(many, "order_name", "left_semi")
    full = _with_heads(few, heads, many=False).unionByName(_with_heads(hot, hot_heads, many=True))
    known = full.select(
        "order_id",
        "quantity",
        F.col("order_name").alias("Name"),
        _text("order_id").alias("Id"),
        F.upper("email").alias("Email"),
        _time("created_at").alias("Created at"),
        _time("cancelled_at").alias("Cancelled at"),
        *[_text(c).alias(header) for header, c in ORDER_HEADERS.items()],
        _guarded("shipping_zip").alias("Shipping Zip"),
        _text("quantity").alias("Lineitem quantity"),
        F.col("lineitem_name").alias("Lineitem name"),
        _text("price").alias("Lineitem price"),
        _text("discount").alias("Lineitem discount"),
        F.col("sku").alias("Lineitem sku"),
        F.lit("true").alias("Lineitem taxable"),
    )
    heads = ORDER_FIELDS_BEFORE_COUNTS + ORDER_FIELDS_AFTER_COUNTS
    items = _filled(known, ITEM_FIELDS, F.col("quantity"))
    return known.select("*", *_filled(known, heads, F.col("order_id")), *items).drop("order_id", "quantity")


def raw_products(store: SampleStore) -> DataFrame:
    """One row per variant, plus an image-only row for titles of two words."""
    body = ["lineitem_name", "price", "sku", "cost_per_item", "status", "product_title"]
    few, hot, _ = _with_one_lead(store.variants("handle", *body), "handle", body)
    marked = few.unionByName(hot)
    brand_and_type = F.split(F.substring_index("lineitem_name", " - ", -1), " / ")
    leads = F.col("leads")
    own = marked.select(
        "leads",
        (F.col("price") * 100).cast("bigint").alias("number"),
        F.length("handle").alias("size"),
        F.col("handle").alias("Handle"),
        F.when(leads, F.col("product_title")).alias("Title"),
        F.when(leads, F.col("status")).alias("Status"),
        F.when(leads, F.lit("Brand")).alias("Option1 Name"),
        brand_and_type[0].alias("Option1 Value"),
        brand_and_type[1].alias("Option2 Value"),
        F.col("sku").alias("Variant SKU"),
        _text("price").alias("Variant Price"),
        _text("cost_per_item").alias("Cost per item"),
    )
    size = F.when(F.col("leads"), F.col("size"))
    about = PRODUCT_FIELDS_BEFORE_COUNTS + PRODUCT_FIELDS_AFTER_COUNTS
    names = [Field("Option2 Name", name="option2_name"), Field("Option3 Name", name="option3_name")]
    # A third option would be part of the line name.
    rows = own.select(
        "*",
        *_filled(own, about + names, size),
        *_filled(own, VARIANT_FIELDS, F.col("number"), "Option3 Value"),
    ).drop("leads", "number", "size")
    images = (
        store.variants("handle")
        .distinct()
        .filter(F.col("handle").contains("-"))
        .select(
            F.col("handle").alias("Handle"),
            F.concat(F.lit("https://example.com/"), "handle").alias("Image Src"),
        )
    )
    return rows.unionByName(images, allowMissingColumns=True)


def raw_exports(store: SampleStore) -> dict[str, DataFrame]:
    return {
        "customers": raw_customers(store),
        "orders": raw_orders(store),
        "products": raw_products(store),
    }
