"""A small store with every awkward case, for Spark and for the SQL check.

Random but seeded: NULLs in most columns, customers who share an email, orders
at the same instant, one email with a third of all orders, one order and one
line name with a third of all lines, titles with wildcards and backslashes.
"""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from mercato.store import Store

SCHEMAS = {
    "customers": "customer_id bigint, email string, accepts_email_marketing boolean,"
    " accepts_sms_marketing boolean, province_code string, total_spent decimal(12,2),"
    " total_orders int",
    "orders": "order_name string, order_id bigint, email string, financial_status string,"
    " created_at timestamp_ntz, cancelled_at timestamp_ntz, source string,"
    " subtotal decimal(12,2), shipping decimal(12,2), total decimal(12,2),"
    " discount_code string, discount_amount decimal(12,2), refunded_amount decimal(12,2),"
    " shipping_zip string, shipping_province string",
    "order_items": "order_name string, email string, created_at timestamp_ntz, quantity int,"
    " lineitem_name string, price decimal(12,2), sku string",
    "products": "handle string, title string, product_category string",
    "variants": "handle string, product_title string, lineitem_name string, sku string,"
    " price decimal(12,2), cost_per_item decimal(12,2), status string",
}
TITLES = ["Bread", "Bread Loaf", "100% Rye", "Mix_A", "Back\\slash", "Tea (green)", "B", "Übel"]


def _money(r, top=2000):
    return None if r.random() < 0.05 else Decimal(r.randrange(0, top * 100)) / 100


def _variants(r):
    rows = []
    for i in range(60):
        title = r.choice([*TITLES, None])
        option = r.choice(["Small", "Big", "100%", None])
        name = title if option is None or title is None else f"{title} - {option}"
        sku = r.choice([None, f"S{i % 25}", f"S{i % 25}"])
        cost = None if r.random() < 0.3 else Decimal(r.randrange(50, 900)) / 100
        rows.append(
            (title and title.replace(" ", "-"), title, name, sku, _money(r, 20), cost,
             r.choice(["active", "active", "draft", None]))
        )
    return rows


def _name(r):
    title = r.choice(TITLES)
    kind = r.random()
    if kind < 0.2:
        return title
    if kind < 0.5:
        return f"{title} - {r.choice(['Small', 'Big', '100%'])}"
    if kind < 0.7:
        return title.replace("%", " percent").replace("_", "x") + r.choice(["", " gift\nbox"])
    return r.choice([None, "Tip", "Old thing", "bread", ""])


def tables(seed: int) -> dict[str, list[tuple]]:
    r = random.Random(seed)
    emails = [f"p{i}@x.com" for i in range(60)]
    customers = [
        (i, None if r.random() < 0.05 else r.choice(emails[:50] + ["hot@x.com"] * 20),
         r.choice([True, False, None]), r.choice([True, False, None]), None,
         r.choice([Decimal("0.00"), Decimal("50.00"), _money(r)]), r.choice([0, 1, 1, 1, 2, 5, None]))
        for i in range(150)
    ]
    start = dt.datetime(2001, 8, 2) - dt.timedelta(days=500)
    orders, instants = [], [start + dt.timedelta(hours=r.randrange(0, 500 * 24)) for _ in range(150)]
    # Instants exactly on the day limits the questions use.
    as_of = dt.datetime(2001, 8, 2)
    instants += [as_of - dt.timedelta(days=d) for d in (30, 31, 75, 76, 125, 126, 150, 395, 396)]
    for i in range(400):
        email = "hot@x.com" if i % 3 == 0 else r.choice([*emails, None])
        instant = None if r.random() < 0.03 else r.choice(instants)
        name = f"#{r.randrange(400)}" if r.random() < 0.1 else f"#{i}"
        subtotal = r.choice([Decimal("20.00"), _money(r), Decimal("0.00")])
        orders.append(
            (name, i, email, r.choice(["paid", "paid", "paid", "pending", None]), instant,
             instant if r.random() < 0.1 else None,
             r.choice([None, "pos", "iphone", "POS", "web", "subscription_contract",
                       "subscription_x", "shopify_draft_order", "web"]),
             subtotal, _money(r, 10), _money(r), r.choice([None, "A", "(none)", "B"]),
             _money(r, 5), r.choice([None, Decimal("0.00"), Decimal("3.00")]),
             r.choice([None, "00001", "00002", *[f"{z:05}" for z in range(30)]]),
             r.choice([None, "NY", "CA", "TX"]))
        )
    items = []
    for i in range(900):
        order = "#7" if i % 3 == 0 else r.choice([f"#{r.randrange(420)}", None])
        name = "Bread - Small" if i % 3 == 1 else _name(r)
        items.append(
            (order, r.choice([*emails[:20], "hot@x.com", None]), None, r.choice([None, 1, 1, 2, 5]),
             name, _money(r, 20), r.choice([None, f"S{r.randrange(30)}"]))
        )
    products = [(t.replace(" ", "-"), t, r.choice([None, "Food"])) for t in TITLES[:6]]
    return {
        "customers": customers,
        "orders": orders,
        "order_items": items,
        "products": products,
        "variants": _variants(r),
    }


def spark_store(spark, data) -> Store:
    return Store({n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})


def duck_store(con, data) -> None:
    for name, rows in data.items():
        table = "store_orders" if name == "orders" else name
        columns = SCHEMAS[name].replace("timestamp_ntz", "timestamp").replace("string", "varchar")
        con.execute(f"CREATE OR REPLACE TABLE {table} ({columns})")
        if rows:
            con.executemany(
                f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows
            )
