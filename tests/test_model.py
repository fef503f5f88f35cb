import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mercato.plans import model
from mercato.store import online_only


def raw(spark, headers, rows):
    schema = ", ".join(f"`{h}` string" for h in headers)
    return spark.createDataFrame(rows, schema)


def test_customers(spark):
    headers = ["Customer ID", "Email", "Accepts Email Marketing", "Default Address Zip",
               "Default Address Phone", "Phone", "Total Spent", "Total Orders", "Tax Exempt"]
    df = model.customers(
        raw(spark, headers, [
            ("'42", "A@X.com", "yes", "'11201", "''5", "'+1", "10.50", "3", "no"),
            ("n/a", None, "Yes", None, None, None, "99999999999.00", "1.6", None),
        ])
    )
    assert len(df.columns) == 21
    a, b = df.collect()
    assert (a.customer_id, a.email, a.zip, a.address_phone, a.phone) == (42, "a@x.com", "11201", "'5", "+1")
    assert (a.accepts_email_marketing, a.tax_exempt, a.accepts_sms_marketing) == (True, False, None)
    assert (a.total_spent, a.total_orders, a.company) == (Decimal("10.50"), 3, None)
    assert (b.customer_id, b.accepts_email_marketing, b.total_spent, b.total_orders) == (None, False, None, 2)


ORDER_HEADERS = ["Name", "Id", "Email", "Created at", "Total", "Lineitem quantity", "Lineitem name",
                 "Lineitem price", "Lineitem discount", "Lineitem sku", "Discount Code", "Shipping Zip"]
AT = "2026-07-04 13:52:26 -0400"
ORDERS = [
    ("#1", "7", "A@x.com", AT, "9.00", "2", "Tea", "3.00", "0.50", "S1", "", "'02139"),
    ("#1", None, "a@x.com", AT, None, "1", "Cup", "4.00", None, "", None, None),
    ("#1", None, "a@x.com", AT, None, "x", "Pot", "5.00", None, None, None, None),
    ("#2", "8", None, AT, "n/a", "1", "Tea", None, None, None, None, None),
    ("#3", "9", None, AT, None, "1", "Tea", "3.00", None, None, None, None),
    (None, "5", None, AT, "1.00", "1", "Tea", "3.00", None, None, None, None),
    (None, None, None, AT, None, "1", "Tea", "3.00", None, None, None, None),
]


def test_order_items(spark):
    df = model.order_items(raw(spark, ORDER_HEADERS, ORDERS))
    assert (df.count(), len(df.columns)) == (7, 15)
    by_name = {(r.order_name, r.lineitem_name): r for r in df.collect()}
    assert {r.order_id for k, r in by_name.items() if k[0] == "#1"} == {7}
    tea, cup, pot = (by_name[("#1", n)] for n in ("Tea", "Cup", "Pot"))
    assert (tea.line_total, cup.line_total, pot.line_total) == (Decimal("5.50"), Decimal("4.00"), None)
    assert (tea.sku, cup.sku, tea.email) == ("S1", None, "a@x.com")
    assert by_name[("#2", "Tea")].line_total is None
    # Rows without a name share one id.
    assert [r.order_id for r in df.filter("order_name is null").collect()] == [5, 5]


def test_orders(spark):
    df = model.orders(raw(spark, ORDER_HEADERS, ORDERS))
    assert len(df.columns) == 71
    got = {r.order_name: r for r in df.collect()}
    assert set(got) == {"#1", "#2"}  # no total: no order; no name: no order
    one = got["#1"]
    assert (one.line_count, one.total_quantity, one.total) == (3, 3, Decimal("9.00"))
    assert (one.discount_code, one.shipping_zip, one.order_id) == (None, "02139", 7)
    assert one.created_at == dt.datetime(2026, 7, 4, 13, 52, 26)
    assert got["#2"].total is None


PRODUCT_HEADERS = ["Handle", "Title", "Status", "Option1 Value", "Option2 Value", "Option3 Value",
                   "Variant Price", "Variant SKU", "Image Src", "Gift Card",
                   "Product rating count (product.metafields.reviews.rating_count)"]
PRODUCTS = [
    ("tea", "Tea", "draft", "Small", None, "Tin", "3.00", "", "img1", "false", "12"),
    ("tea", None, None, "Big", "Loose", None, "5.00", "S2", None, None, None),
    ("tea", None, None, None, None, None, None, None, "img2", None, None),
    ("mug", "Mug", None, "Default Title", None, None, "9.00", "S3", None, "true", None),
    ("late", "Late", None, None, None, None, None, None, None, None, None),
    ("late", None, None, None, None, None, "1.00", None, None, None, None),
    (None, "Lost", None, None, None, None, "2.00", None, None, None, None),
]


def test_products(spark):
    df = model.products(raw(spark, PRODUCT_HEADERS, PRODUCTS))
    assert len(df.columns) == 23
    got = {r.handle: r for r in df.collect()}
    assert set(got) == {"tea", "mug", "late"}
    tea = got["tea"]
    assert (tea.variant_count, tea.min_price, tea.max_price, tea.image_count) == (
        2, Decimal("3.00"), Decimal("5.00"), 2)
    assert (tea.status, tea.gift_card, tea.rating_count, tea.flavor) == ("draft", False, 12, None)
    assert (got["mug"].status, got["mug"].gift_card) == ("active", True)


def test_variants(spark):
    df = model.variants(raw(spark, PRODUCT_HEADERS, PRODUCTS))
    assert len(df.columns) == 23
    got = {(r.handle, r.option1_value): r for r in df.collect()}
    assert len(got) == df.count() == 5
    assert got[("tea", "Small")].lineitem_name == "Tea - Small / Tin"
    assert got[("tea", "Small")].sku is None
    big = got[("tea", "Big")]
    assert (big.lineitem_name, big.product_title, big.status) == ("Tea - Big / Loose", "Tea", "draft")
    mug = got[("mug", None)]
    assert (mug.lineitem_name, mug.status) == ("Mug", "active")
    # Back-fill looks at priced rows only.
    assert got[("late", None)].product_title is None
    # Rows without a handle form one product.
    assert got[(None, None)].product_title == "Lost"


@pytest.mark.parametrize("source, online", [(None, 1), ("web", 1), ("POS", 1), ("pos", 0), ("iphone", 0)])
def test_online_orders(spark, source, online):
    df = spark.range(1).select(F.lit(source).cast("string").alias("source"))
    assert online_only(df).count() == online
