"""SQL for the tables of the model, the derived views and the reusable operators.

The export-shaped rows hold the sample data as text, so reading them back must
give the typed sample data again; that is what these statements select.
"""

from __future__ import annotations

from oracle.questions import (
    QUESTIONS,
    MONEY_PERCENTILE,
    avg,
    big,
    cents,
    dbl,
    percentile_columns,
    ranked,
)

OPERATORS: dict[str, str] = {}


def texts(key: str, *names: str) -> str:
    return ", ".join(
        f"CASE WHEN {key} % 3 = 0 THEN NULL WHEN {key} % 5 = 1 THEN '{n} \"q\",' || chr(10) || {key}"
        f" ELSE '{n} ' || {key} END AS {n}"
        for n in names
    )


def flags(key: str, *names: str) -> str:
    return ", ".join(f"CASE WHEN {key} % 5 <> 0 THEN {key} % 2 = 0 END AS {n}" for n in names)


def amounts(key: str, *names: str) -> str:
    return ", ".join(
        f"CASE WHEN {key} % 7 <> 0 THEN CAST({key} % 1000 + 0.25 AS DECIMAL(12,2)) END AS {n}" for n in names
    )


def moments(key: str, *names: str) -> str:
    return ", ".join(
        f"CASE WHEN {key} % 11 <> 0 THEN TIMESTAMP '2024-03-01 10:20:30' + to_days(CAST({key} % 28 AS INTEGER)) END AS {n}"
        for n in names
    )


OPERATORS["t0_export_timestamps"] = """
SELECT order_name, created_at, cancelled_at FROM store_orders
WHERE order_name IN (SELECT order_name FROM order_items)
"""
OPERATORS["t1_customers"] = f"""
SELECT customer_id, 'Customer ' || customer_id AS first_name, email,
       accepts_email_marketing, accepts_sms_marketing,
       {flags("customer_id", "accepts_whatsapp_marketing", "tax_exempt")},
       province_code, lpad(CAST(customer_id % 500 AS VARCHAR), 5, '0') AS zip,
       TRY_CAST(total_spent AS DECIMAL(12,2)) AS total_spent, total_orders,
       {texts("customer_id", "last_name", "company", "address1", "address2", "city", "country_code",
              "address_phone", "phone", "note", "tags")}
FROM customers
"""
OPERATORS["t2_order_items"] = f"""
SELECT order_name, order_id, email, created_at, quantity, lineitem_name, price,
       {amounts("quantity", "compare_at_price")},
       CAST(quantity * price - discount AS DECIMAL(24,2)) AS line_total, discount, sku,
       {flags("quantity", "requires_shipping")}, true AS taxable,
       {texts("quantity", "fulfillment_status", "vendor")}
FROM order_items
"""
_PLACE = (
    "name", "street", "address1", "address2", "company", "city", "province_name", "country", "phone",
)
_HEAD_TEXTS = (
    *[f"{kind}_{part}" for kind in ("billing", "shipping") for part in _PLACE],
    *[f"tax_{i}_name" for i in range(1, 6)],
    "billing_zip", "billing_province", "fulfillment_status", "currency", "shipping_method", "notes",
    "note_attributes", "payment_method", "payment_reference", "payment_id", "payment_terms_name",
    "payment_references", "employee", "location", "device_id", "tags", "risk_level", "phone",
    "receipt_number",
)
OPERATORS["t3_orders"] = f"""
SELECT order_name, order_id, email, financial_status, created_at, cancelled_at,
       subtotal, shipping, total, discount_code, discount_amount, refunded_amount,
       n.line_count, n.total_quantity, shipping_zip, shipping_province, source,
       {moments("order_id", "paid_at", "fulfilled_at", "next_payment_due_at")},
       {flags("order_id", "accepts_marketing")},
       {amounts("order_id", "taxes", "outstanding_balance", "duties",
                *[f"tax_{i}_value" for i in range(1, 6)])},
       {texts("order_id", *_HEAD_TEXTS)}
FROM store_orders
JOIN (SELECT order_name, count(*) AS line_count, {big("sum(quantity)")} AS total_quantity
      FROM order_items GROUP BY ALL) n USING (order_name)
"""
# Status is exported on one row per product: that of its first variant.
_LEAD = (
    "arg_min(status, (lineitem_name, price, coalesce(sku, ''), coalesce(cost_per_item, 0), status))"
)
OPERATORS["t4_products"] = f"""
SELECT handle, any_value(product_title) AS title, {_LEAD} AS status, count(*) AS variant_count,
       min(price) AS min_price, max(price) AS max_price,
       CAST(if(contains(handle, '-'), 1, 0) + if(length(handle) % 3 <> 0, 1, 0) AS BIGINT) AS image_count,
       {flags("length(handle)", "published", "gift_card")},
       CAST(length(handle) % 100 AS INTEGER) AS rating_count,
       {texts("length(handle)", "vendor", "product_category", "type", "tags", "seo_title",
              "seo_description", "image_src", "allergen_information", "bakery_items_included",
              "dietary_preferences", "flavor", "flour_grain_type", "body_html")}
FROM variants GROUP BY handle
"""
OPERATORS["t5_variants"] = f"""
SELECT v.handle, v.product_title, l.status, 'Brand' AS option1_name, p_brand AS option1_value,
       p_type AS option2_value, v.lineitem_name, v.sku, v.price, v.cost_per_item,
       CAST(c + 0.5 AS DOUBLE) AS grams, {amounts("c", "compare_at_price")},
       {flags("c", "requires_shipping", "taxable")},
       {texts("length(handle)", "vendor", "option2_name", "option3_name")},
       CAST(NULL AS VARCHAR) AS option3_value,
       {texts("c", "weight_unit", "inventory_tracker", "inventory_policy", "fulfillment_service", "barcode")}
FROM (SELECT handle, product_title, lineitem_name, sku, price, cost_per_item,
             CAST(price * 100 AS BIGINT) AS c,
             split_part(split_part(lineitem_name, ' - ', 2), ' / ', 1) AS p_brand,
             split_part(split_part(lineitem_name, ' - ', 2), ' / ', 2) AS p_type
      FROM variants) v
JOIN (SELECT handle, {_LEAD} AS status FROM variants GROUP BY handle) l USING (handle)
"""
OPERATORS["t6_online_orders"] = "SELECT * FROM online_orders"
OPERATORS["t7_catalog_items"] = "SELECT * FROM catalog_items"

OPERATORS["m1_catalog_match"] = "SELECT DISTINCT sku, lineitem_name FROM catalog_items"
OPERATORS["m2_best_variant"] = f"""
SELECT sku, lineitem_name, product_title, {dbl("cost_per_item")} AS cost_per_item FROM best
"""
OPERATORS["m3_first_orders"] = """
SELECT o.email, o.created_at, o.order_name, count(*) AS n
FROM online_orders o JOIN buyers b ON b.email = o.email AND b.first_at = o.created_at GROUP BY ALL
"""
OPERATORS["m4_last_orders"] = "SELECT email, last_at AS last_order_at FROM buyers"
OPERATORS["m5_repeat_customers"] = "SELECT email, orders FROM buyers WHERE orders >= 2"
OPERATORS["m6_global_rank"] = f"""
SELECT customer_id, {cents("total_spent")} AS spend, row_number() OVER w AS row_number,
       {big(f"sum({cents('total_spent')}) OVER (w ROWS UNBOUNDED PRECEDING)")} AS upto_spend
FROM customers WINDOW w AS (ORDER BY total_spent DESC NULLS LAST, customer_id)
"""
OPERATORS["m7_percentiles_by_state"] = f"""
SELECT state, count(*) AS rows,
       {percentile_columns("v", {"p5": 5, "p25": 25, "p50": 50, "p90": 90}, MONEY_PERCENTILE)}
FROM ({ranked('''(SELECT shipping_province AS state, subtotal FROM online_orders
                  WHERE financial_status = 'paid')''', cents("subtotal"), "state")})
GROUP BY state
"""
OPERATORS["m7_approximate_percentiles_by_state"] = f"""
SELECT shipping_province AS state, count(*) AS rows,
       {", ".join(f"{dbl(f'quantile_disc(subtotal, {p / 100})')} AS p{p}" for p in (5, 25, 50, 90))}
FROM online_orders WHERE financial_status = 'paid' GROUP BY ALL
"""
# Sketches of so few customers hold each of them, so their counts are exact here.
for _key in ("d1_top_products", "g1_state_scorecard", "g2_top_zips"):
    OPERATORS[f"{_key}_approximate"] = QUESTIONS[_key]
OPERATORS["b4_ltv_distribution_approximate"] = f"""
SELECT count(*) AS customers, {avg("total_spent")} AS avg_spend,
       {", ".join(f"{dbl(f'quantile_disc(total_spent, {p / 100})')} AS {name}" for name, p in
                  (("median_spend", 50), ("p75_spend", 75), ("p90_spend", 90), ("p95_spend", 95), ("max_spend", 100)))}
FROM customers WHERE total_orders >= 1
"""
OPERATORS["m12_pairs"] = """
SELECT a, b, together, n.orders AS baskets_of_a
FROM (SELECT x.lineitem_name AS a, y.lineitem_name AS b, count(*) AS together
      FROM (SELECT DISTINCT order_name, lineitem_name FROM order_items) x
      JOIN (SELECT DISTINCT order_name, lineitem_name FROM order_items) y USING (order_name)
      WHERE x.lineitem_name < y.lineitem_name GROUP BY ALL HAVING together >= 2)
JOIN (SELECT lineitem_name AS a, count(DISTINCT order_name) AS orders
      FROM order_items GROUP BY ALL) n USING (a)
"""
OPERATORS["s6_load_summary"] = """
SELECT 'customers' AS "table", count(*) AS n FROM customers
UNION ALL SELECT 'orders', count(*) FROM store_orders
UNION ALL SELECT 'order_items', count(*) FROM order_items
UNION ALL SELECT 'products', count(*) FROM products
UNION ALL SELECT 'variants', count(*) FROM variants
"""
OPERATORS["s7_table_preview"] = "SELECT * FROM store_orders ORDER BY order_name LIMIT 100"
OPERATORS["k3_capped_result"] = f"""
SELECT order_name, lineitem_name, quantity, {dbl("price")} AS price, {dbl("discount")} AS discount,
       (SELECT count(*) FROM order_items) > 10000 AS truncated
FROM order_items
ORDER BY order_name NULLS FIRST, lineitem_name NULLS FIRST, quantity NULLS FIRST,
         order_items.price NULLS FIRST, order_items.discount NULLS FIRST
LIMIT 10000
"""
# The views in their order, with description, source here, columns and types.
_ORDER_COLUMNS = (
    ("order_name", "string"), ("order_id", "bigint"), ("email", "string"), ("financial_status", "string"),
    ("created_at", "timestamp_ntz"), ("cancelled_at", "timestamp_ntz"), ("source", "string"),
    ("subtotal", "decimal(12,2)"), ("shipping", "decimal(12,2)"), ("total", "decimal(12,2)"),
    ("discount_code", "string"), ("discount_amount", "decimal(12,2)"), ("refunded_amount", "decimal(12,2)"),
    ("shipping_zip", "string"), ("shipping_province", "string"),
)
_LINE_COLUMNS = (
    ("order_name", "string"), ("order_id", "bigint"), ("quantity", "int"), ("lineitem_name", "string"),
    ("price", "decimal(12,2)"), ("discount", "decimal(12,2)"), ("sku", "string"), ("email", "string"),
    ("created_at", "timestamp_ntz"),
)
_VIEWS = (
    ("customers", "One row per customer.", "customers", (
        ("customer_id", "bigint"), ("email", "string"), ("accepts_email_marketing", "boolean"),
        ("accepts_sms_marketing", "boolean"), ("total_spent", "decimal(18,2)"), ("total_orders", "int"),
        ("province_code", "string"))),
    ("orders", "One row per order, with line and unit counts.", "store_orders", _ORDER_COLUMNS),
    ("online_orders", "Orders that are not point-of-sale.", "online_orders", _ORDER_COLUMNS),
    ("order_items", "One row per line of an order.", "order_items", _LINE_COLUMNS),
    ("catalog_items", "Lines whose product is in the current catalog.", "catalog_items", _LINE_COLUMNS),
    ("products", "One row per product, with variant counts and price range.", "products", (
        ("handle", "string"), ("title", "string"), ("variant_count", "bigint"), ("min_price", "decimal(12,2)"),
        ("max_price", "decimal(12,2)"), ("product_category", "string"))),
    ("variants", "One row per product variant.", "variants", (
        ("handle", "string"), ("product_title", "string"), ("lineitem_name", "string"), ("sku", "string"),
        ("price", "decimal(12,2)"), ("cost_per_item", "decimal(12,2)"), ("status", "string"))),
)
OPERATORS["s5_catalog_profile"] = "\nUNION ALL ".join(
    f"""SELECT '{view}' AS "table", '{description}' AS description, (SELECT count(*) FROM {table}) AS row_count,
       CAST({place} AS INTEGER) AS position, '{column}' AS "column", '{kind}' AS "type\""""
    for view, description, table, columns in _VIEWS
    for place, (column, kind) in enumerate(columns, 1)
)
OPERATORS["k4_json_safe_orders"] = f"""
SELECT order_name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       strftime(created_at, '%Y-%m-%d') AS day, {dbl("subtotal")} AS subtotal,
       email AS buyer_email, {dbl("total")} AS buyer_total,
       {dbl("shipping")} AS shipping, {dbl("discount_amount")} AS discount_amount,
       {dbl("total")} AS mapped_total, CASE WHEN shipping <> 0 THEN {dbl("total")} END AS ratio
FROM store_orders
"""
OPERATORS["k6_session_view"] = f"""
SELECT source, count(*) AS orders, {dbl("sum(subtotal)")} AS revenue
FROM online_orders WHERE subtotal > 100000 GROUP BY ALL
"""
_EXPORTED = """store_orders JOIN (SELECT order_name, count(*) AS lines, sum(quantity) AS units
                                  FROM order_items GROUP BY ALL) USING (order_name)"""
OPERATORS["s4_exports_read_back"] = "\nUNION ALL ".join(
    f"SELECT '{measure}' AS measure, {big(value)} AS value FROM {source}"
    for measure, value, source in (
        ("orders", "count(*)", _EXPORTED),
        ("lines", "sum(lines)", _EXPORTED),
        ("units", "sum(units)", _EXPORTED),
        ("subtotal_cents", f"sum({cents('subtotal')})", _EXPORTED),
        ("variants", "count(*)", "variants"),
        ("cost_cents", f"sum({cents('cost_per_item')})", "variants"),
        ("customers", "count(*)", "customers"),
        ("customer_orders", "sum(total_orders)", "customers"),
    )
)
OPERATORS["k6_user_tables"] = """
SELECT 'big_orders' AS "table", count(*) AS row_count, 1::INTEGER AS position, 'order_name' AS "column", 'string' AS "type"
FROM online_orders WHERE subtotal > 100000
UNION ALL SELECT 'big_orders', count(*), 2, 'subtotal', 'decimal(12,2)' FROM online_orders WHERE subtotal > 100000
UNION ALL SELECT 'notes', count(*), 1, 'order_name', 'string' FROM online_orders WHERE subtotal > 300000
UNION ALL SELECT 'notes', count(*), 2, 'note', 'string' FROM online_orders WHERE subtotal > 300000
UNION ALL SELECT 'notes', count(*), 3, 'stars', 'int' FROM online_orders WHERE subtotal > 300000
"""
OPERATORS["k6_sql_time_function"] = OPERATORS["t0_export_timestamps"]
OPERATORS["k1_stored_tables"] = QUESTIONS["d5_product_margin"]
OPERATORS["k1_stored_raw_tables"] = """
SELECT 'raw_customers' AS "table", count(*) AS rows, count(DISTINCT customer_id) AS keys FROM customers
UNION ALL SELECT 'raw_orders', count(*), count(DISTINCT order_name) FROM order_items
UNION ALL SELECT 'raw_products', (SELECT count(*) FROM variants)
    + (SELECT count(DISTINCT handle) FROM variants WHERE contains(handle, '-')),
    (SELECT count(DISTINCT handle) FROM variants)
"""
OPERATORS["k5_csv_read_back"] = f"""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, 'says "hi", ' || email AS quoted,
       ' first' || chr(10) || email || ',second ' AS lines,
       CASE WHEN customer_id % 3 <> 0 THEN email END AS missing,
       '["' || email || '","' || province_code || '"]' AS nested, {dbl("total_spent")} AS total_spent
FROM customers
"""
OPERATORS["m1_wildcard_titles"] = """
SELECT sku, lineitem_name, product_title FROM (
  SELECT k.sku, k.lineitem_name, t.product_title,
         row_number() OVER (PARTITION BY k.sku, k.lineitem_name ORDER BY length(product_title) DESC, product_title DESC) AS r
  FROM (SELECT DISTINCT sku, lineitem_name FROM order_items) AS k
  JOIN (SELECT DISTINCT '%' || replace(string_split(lineitem_name, ' - ')[-1], ' / ', '_/_') AS product_title FROM variants) AS t
    ON k.lineitem_name LIKE t.product_title || '%')
WHERE r = 1
"""
for _table, _key in (("customers", "t1_customers"), ("orders", "t3_orders"), ("order_items", "t2_order_items"),
                     ("products", "t4_products"), ("variants", "t5_variants")):
    OPERATORS[f"s4_{_table}_read_back"] = OPERATORS[_key]
for _table in ("orders", "order_items", "variants"):
    OPERATORS[f"s4_split_{_table}_read_back"] = OPERATORS[f"s4_{_table}_read_back"]
