"""The modeled tables as SQL over the sample tables, one CTE each."""

CUSTOMERS = """
SELECT c.c_custkey AS customer_id,
       'cust' || c.c_custkey || '@example.com' AS email,
       c.c_custkey % 3 <> 0 AS accepts_email_marketing,
       c.c_custkey % 4 = 0 AS accepts_sms_marketing,
       n.n_name AS province_code,
       CAST(coalesce(f.spent, 0) AS DECIMAL(18,2)) AS total_spent,
       CAST(coalesce(f.orders, 0) AS INTEGER) AS total_orders
FROM customer c
JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS spent
           FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) f
       ON f.o_custkey = c.c_custkey
"""

ORDERS = """
SELECT '#' || o.o_orderkey AS order_name,
       o.o_orderkey AS order_id,
       CASE WHEN o.o_orderkey % 97 <> 0 THEN 'cust' || o.o_custkey || '@example.com' END AS email,
       CASE o.o_orderstatus
            WHEN 'F' THEN 'paid'
            WHEN 'O' THEN if(o.o_orderkey % 2 = 0, 'paid', 'partially_refunded')
            WHEN 'P' THEN 'pending' END AS financial_status,
       CAST(o.o_orderdate AS TIMESTAMP) + to_seconds(o.o_orderkey * 7919 % 86400) AS created_at,
       CASE WHEN o.o_orderkey % 41 = 0
            THEN CAST(o.o_orderdate AS TIMESTAMP) + to_seconds(o.o_orderkey * 7919 % 86400 + 86400)
            END AS cancelled_at,
       CASE left(o.o_orderpriority, 1)
            WHEN '1' THEN 'subscription_contract'
            WHEN '2' THEN 'web'
            WHEN '4' THEN if(o.o_orderkey % 2 = 0, 'pos', 'iphone')
            WHEN '5' THEN 'shopify_draft_order' END AS source,
       CAST(o.o_totalprice AS DECIMAL(12,2)) AS subtotal,
       CAST(if(o.o_orderkey % 4 = 0, 0.00, 7.95) AS DECIMAL(12,2)) AS shipping,
       CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) + if(o.o_orderkey % 4 = 0, 0.00, 7.95)
            AS DECIMAL(12,2)) AS total,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'WELCOME10' WHEN 1 THEN 'BREAD5' END AS discount_code,
       CAST(CASE o.o_orderkey % 5 WHEN 0 THEN 10.00 WHEN 1 THEN 5.00 ELSE 0.00 END
            AS DECIMAL(12,2)) AS discount_amount,
       CAST(if(o.o_orderkey % 23 = 0, 10.00, 0.00) AS DECIMAL(12,2)) AS refunded_amount,
       lpad(CAST(o.o_custkey % 500 AS VARCHAR), 5, '0') AS shipping_zip,
       CASE WHEN o.o_orderkey % 101 <> 0 THEN n.n_name END AS shipping_province
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
"""

ONLINE_ORDERS = """
SELECT * FROM store_orders WHERE coalesce(source, '') <> 'pos' AND coalesce(source, '') <> 'iphone'
"""

# Part with the title and names that both lines and variants use.
TITLES = """
SELECT p_partkey AS key,
       if(p_partkey % 13 = 0, split_part(p_name, ' ', 1), p_name) AS title,
       if(p_partkey % 13 = 0, split_part(p_name, ' ', 1), p_name)
           || ' - ' || p_brand || ' / ' || p_type AS full_name,
       CAST(p_retailprice AS DECIMAL(12,2)) AS price
FROM part
"""

VARIANTS = """
SELECT replace(title, ' ', '-') AS handle,
       title AS product_title,
       full_name AS lineitem_name,
       CASE WHEN key % 5 <> 0 THEN 'SKU-' || key END AS sku,
       price,
       CASE WHEN key % 2 <> 0 THEN CAST(price * CAST(0.4 AS DECIMAL(2,1)) AS DECIMAL(12,2)) END
           AS cost_per_item,
       if(key % 17 = 0, 'draft', 'active') AS status
FROM titles
"""

PRODUCTS = """
SELECT handle, max(product_title) AS title, count(price) AS variant_count,
       min(price) AS min_price, max(price) AS max_price,
       'Category ' || upper(handle) AS product_category
FROM variants GROUP BY handle
"""

ORDER_ITEMS = """
SELECT o.order_name, o.order_id, o.email, o.created_at,
       CAST(l.l_quantity AS INTEGER) AS quantity,
       CASE WHEN t.key % 29 = 0 THEN 'Tip'
            WHEN t.key % 31 = 0 THEN 'Legacy ' || t.title
            WHEN t.key % 7 = 0 THEN t.title || ' (gift)'
            ELSE t.full_name END AS lineitem_name,
       CASE WHEN t.key % 29 = 0 OR t.key % 5 = 0 THEN NULL
            WHEN t.key % 11 = 0 THEN 'OLD-' || t.key
            WHEN t.key % 31 = 0 THEN NULL
            ELSE 'SKU-' || t.key END AS sku,
       t.price,
       CAST(l.l_discount * 10 AS DECIMAL(12,2)) AS discount
FROM lineitem l
JOIN titles t ON t.key = l.l_partkey
JOIN store_orders o ON o.order_id = l.l_orderkey
"""

CATALOG_ITEMS = """
SELECT i.* FROM order_items i
WHERE EXISTS (SELECT 1 FROM variants v
              WHERE v.sku = i.sku OR i.lineitem_name LIKE v.product_title || '%')
"""

# The single best variant of each distinct (sku, lineitem_name).
BEST = """
SELECT k.sku, k.lineitem_name, v.product_title, v.cost_per_item
FROM (SELECT DISTINCT sku, lineitem_name FROM order_items) k
LEFT JOIN LATERAL (
    SELECT w.product_title, w.cost_per_item FROM variants w
    WHERE w.sku = k.sku OR w.lineitem_name = k.lineitem_name
       OR k.lineitem_name LIKE w.product_title || '%'
    ORDER BY w.sku = k.sku DESC NULLS LAST, w.lineitem_name = k.lineitem_name DESC NULLS LAST,
             length(w.product_title) DESC, w.product_title DESC, w.cost_per_item DESC NULLS LAST
    LIMIT 1) v ON true
"""

FIRST_SEEN = """
SELECT email, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS orders
FROM online_orders WHERE email IS NOT NULL GROUP BY email
"""

# In dependency order.
CTES = {
    "customers": CUSTOMERS,
    "store_orders": ORDERS,
    "online_orders": ONLINE_ORDERS,
    "titles": TITLES,
    "variants": VARIANTS,
    "products": PRODUCTS,
    "order_items": ORDER_ITEMS,
    "catalog_items": CATALOG_ITEMS,
    "best": BEST,
    "buyers": FIRST_SEEN,
}
