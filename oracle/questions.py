"""The analytic queries as SQL.

Written from the definitions, in another shape than the DataFrame code where
there is a choice: plain joins and windows, ``EXISTS`` and ``LIKE``.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-02'"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def rnd(x: str, digits: int = 2) -> str:
    """Half away from zero on a double."""
    k = f"{10**digits}.0::DOUBLE"
    return f"sign({x}) * floor(abs({x}) * {k} + 0.5::DOUBLE) / {k}"


def rate(num: str, den: str, digits: int = 1) -> str:
    return rnd(f"(100.0::DOUBLE * {dbl(num)} / nullif({dbl(den)}, 0))", digits)


def quotient(num: str, den: str, digits: int = 2) -> str:
    return rnd(f"({dbl(num)} / nullif({dbl(den)}, 0))", digits)


def avg(x: str, digits: int = 2) -> str:
    return quotient(f"sum({x})", f"count({x})", digits)


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def percentile_columns(value: str, percents: dict[str, int], finish: str) -> str:
    """Aggregates over rows that carry 0-based rank ``r`` and count ``k``."""
    out = []
    for name, p in percents.items():
        lo = f"max({value}) FILTER (r = ((k - 1) * {p}) // 100)"
        hi = f"max({value}) FILTER (r = ((k - 1) * {p} + 99) // 100)"
        raw = f"({lo} * 100 + ({hi} - {lo}) * any_value(((k - 1) * {p}) % 100))"
        out.append(f"{finish.format(raw)} AS {name}")
    return ", ".join(out)


MONEY_PERCENTILE = "((({}) + 50) // 100)::DOUBLE / 100.0"
PLAIN_PERCENTILE = "({})::DOUBLE / 100.0"


def ranked(source: str, value: str, by: str = "") -> str:
    """Rows of ``source`` with value ``v``, rank ``r`` and count ``k`` per group."""
    over = f"PARTITION BY {by}" if by else ""
    return (
        f"SELECT *, {value} AS v, row_number() OVER ({over} ORDER BY {value} NULLS LAST) - 1 AS r,"
        f" count({value}) OVER ({over}) AS k FROM {source}"
    )


def cents(x: str) -> str:
    return f"CAST({x} * 100 AS BIGINT)"


DAYS_SINCE = "date_diff('day', CAST({} AS DATE), {})"
MONTH = "CAST(date_trunc('month', {}) AS DATE)"

QUESTIONS: dict[str, str] = {}

# --- A ---------------------------------------------------------------------

QUESTIONS["a1_new_vs_returning_weekly"] = f"""
SELECT CAST(date_trunc('week', o.created_at) AS DATE) AS week,
       count(*) FILTER (o.created_at = b.first_at) AS first_time_orders,
       count(*) FILTER (o.created_at > b.first_at) AS returning_orders,
       {rate("count(*) FILTER (o.created_at > b.first_at)", "count(*)")} AS pct_returning
FROM online_orders o JOIN buyers b USING (email)
GROUP BY ALL
"""
QUESTIONS["a2_repeat_purchase_rate"] = f"""
SELECT count(*) AS customers_ever_bought,
       count(*) FILTER (total_orders >= 2) AS bought_2plus,
       {rate("count(*) FILTER (total_orders >= 2)", "count(*)")} AS repeat_rate_pct
FROM customers WHERE total_orders >= 1
"""
QUESTIONS["a3_acquisition_curve"] = f"""
SELECT {MONTH.format("first_at")} AS acquisition_month, count(*) AS new_customers
FROM buyers GROUP BY ALL
"""
QUESTIONS["a4_cohort_retention"] = f"""
SELECT c.cohort_month, s.cohort_size, c.months_since_first, c.customers_active,
       {rate("c.customers_active", "s.cohort_size")} AS retention_pct
FROM (SELECT {MONTH.format("b.first_at")} AS cohort_month,
             date_diff('month', b.first_at, o.created_at) AS months_since_first,
             count(DISTINCT email) AS customers_active
      FROM online_orders o JOIN buyers b USING (email) GROUP BY ALL) c
JOIN (SELECT {MONTH.format("first_at")} AS cohort_month, count(*) AS cohort_size
      FROM buyers GROUP BY ALL) s USING (cohort_month)
"""
QUESTIONS["a5_time_to_second_purchase"] = f"""
SELECT count(*) AS repeat_customers, {avg("v", 1)} AS avg_days,
       {percentile_columns("v", {"median_days": 50, "p25_days": 25, "p75_days": 75}, PLAIN_PERCENTILE)}
FROM ({ranked('''(
    SELECT email, date_diff('day', any_value(created_at) FILTER (nth = 1),
                            any_value(created_at) FILTER (nth = 2)) AS days
    FROM (SELECT email, created_at,
                 row_number() OVER (PARTITION BY email ORDER BY created_at, order_name) AS nth
          FROM online_orders WHERE email IS NOT NULL)
    WHERE nth < 3 GROUP BY email HAVING count(*) = 2)''', "days")})
"""
QUESTIONS["a6_reactivation_rate"] = f"""
SELECT count(*) AS dormant, count(r.email) AS reactivated,
       {rate("count(r.email)", "count(*)")} AS reactivation_pct
FROM (SELECT email, max(created_at) AS seen FROM online_orders
      WHERE email IS NOT NULL AND created_at < {AS_OF} - INTERVAL 30 DAY GROUP BY email) d
LEFT JOIN (SELECT DISTINCT email FROM online_orders
           WHERE created_at >= {AS_OF} - INTERVAL 30 DAY) r USING (email)
WHERE d.seen < {AS_OF} - INTERVAL 150 DAY AND d.seen >= {AS_OF} - INTERVAL 395 DAY
"""

# --- B ---------------------------------------------------------------------

QUESTIONS["b1_aov"] = f"""
SELECT count(*) AS n, {avg("subtotal")} AS avg_subtotal, {avg("total")} AS avg_total,
       {percentile_columns("v", {"median_subtotal": 50}, MONEY_PERCENTILE)}
FROM ({ranked("online_orders", cents("subtotal"))}
      WHERE financial_status = 'paid' AND cancelled_at IS NULL)
"""
QUESTIONS["b2_aov_monthly"] = f"""
SELECT month, count(*) AS paid_orders, {avg("subtotal")} AS avg_order_value,
       {percentile_columns("v", {"median_order_value": 50}, MONEY_PERCENTILE)}
FROM ({ranked(f'''(SELECT {MONTH.format("created_at")} AS month, subtotal
                   FROM online_orders WHERE financial_status = 'paid')''', cents("subtotal"), "month")})
GROUP BY month
"""
QUESTIONS["b3_aov_new_vs_returning"] = f"""
SELECT customer_type, count(*) AS orders, {avg("subtotal")} AS avg_order_value,
       {percentile_columns("v", {"median_order_value": 50}, MONEY_PERCENTILE)}
FROM ({ranked('''(SELECT if(o.created_at = b.first_at, 'First-Time Buyer', 'Repeat Customer')
                             AS customer_type, o.subtotal
                  FROM online_orders o JOIN buyers b USING (email)
                  WHERE o.financial_status = 'paid')''', cents("subtotal"), "customer_type")})
GROUP BY customer_type
"""
QUESTIONS["b4_ltv_distribution"] = f"""
SELECT count(*) AS customers, {avg("total_spent")} AS avg_spend,
       {percentile_columns("v", {"median_spend": 50, "p75_spend": 75, "p90_spend": 90,
                                 "p95_spend": 95}, MONEY_PERCENTILE)},
       {dbl("max(total_spent)")} AS max_spend
FROM ({ranked("customers", cents("total_spent"))} WHERE total_orders >= 1)
"""
QUESTIONS["b5_purchase_frequency"] = f"""
SELECT count(*) AS repeat_customers, {avg("orders")} AS avg_orders,
       {rnd("avg(365.0::DOUBLE * orders / nullif(days, 0))")} AS orders_per_year,
       {rnd("avg(days / (orders - 1))", 1)} AS avg_days_between
FROM (SELECT orders, date_diff('day', first_at, last_at) AS days FROM buyers WHERE orders >= 2)
"""
QUESTIONS["b6_rfm"] = f"""
SELECT r_score, f_score, m_score, count(*) AS customers, {avg("total_spent")} AS avg_spend
FROM (SELECT c.total_spent,
             ntile(5) OVER (ORDER BY {DAYS_SINCE.format("b.last_at", AS_OF)} DESC NULLS LAST,
                            c.email, c.total_orders, c.total_spent, c.customer_id) AS r_score,
             ntile(5) OVER (ORDER BY c.total_orders, c.email, c.total_spent,
                            c.customer_id) AS f_score,
             ntile(5) OVER (ORDER BY c.total_spent, c.email, c.total_orders,
                            c.customer_id) AS m_score
      FROM customers c JOIN buyers b USING (email) WHERE c.total_orders >= 1)
GROUP BY ALL
"""

# --- C ---------------------------------------------------------------------

QUESTIONS["c1_revenue_quintiles"] = f"""
SELECT ['Top 20% (Best Customers)', 'Next 20%', 'Middle 20%', 'Lower 20%',
        'Bottom 20% (Smallest Spenders)'][tile] AS customer_group,
       count(*) AS customers, {dbl("sum(total_spent)")} AS revenue,
       {rate("sum(total_spent)", "any_value(everything)")} AS pct_revenue
FROM (SELECT total_spent, ntile(5) OVER (ORDER BY total_spent DESC NULLS LAST) AS tile,
             sum(total_spent) OVER () AS everything
      FROM customers WHERE total_orders >= 1)
GROUP BY tile
"""
QUESTIONS["c2_pareto_customers"] = f"""
SELECT {rate("rn", "total")} AS cum_pct_customers, {rate("upto", "everything")} AS cum_pct_revenue
FROM (SELECT row_number() OVER w AS rn, count(*) OVER () AS total,
             sum(total_spent) OVER (w ROWS UNBOUNDED PRECEDING) AS upto,
             sum(total_spent) OVER () AS everything
      FROM customers WHERE total_orders >= 1
      WINDOW w AS (ORDER BY total_spent DESC NULLS LAST, customer_id))
"""
QUESTIONS["c3_revenue_by_product"] = f"""
SELECT product, {dbl("revenue")} AS product_revenue, {rate("revenue", "everything")} AS pct_revenue,
       {rate("upto", "everything")} AS cum_pct_revenue
FROM (SELECT product, revenue, sum(revenue) OVER () AS everything,
             sum(revenue) OVER (ORDER BY revenue DESC NULLS LAST, product
                                ROWS UNBOUNDED PRECEDING) AS upto
      FROM (SELECT i.lineitem_name AS product, sum(i.quantity * i.price) AS revenue
            FROM catalog_items i JOIN online_orders o USING (order_name)
            WHERE o.financial_status = 'paid' AND o.cancelled_at IS NULL
            GROUP BY ALL))
"""
QUESTIONS["c4_revenue_by_variant"] = f"""
SELECT i.sku, i.lineitem_name AS product_variant, {big("sum(i.quantity)")} AS units_sold,
       {dbl("sum(i.quantity * i.price)")} AS revenue
FROM catalog_items i JOIN online_orders o USING (order_name)
WHERE o.financial_status = 'paid' GROUP BY ALL
"""
QUESTIONS["c5_revenue_by_state"] = f"""
SELECT shipping_province AS state, count(*) AS orders, {dbl("sum(subtotal)")} AS revenue,
       {rate("sum(subtotal)", "(SELECT sum(subtotal) FROM online_orders WHERE financial_status = 'paid')")}
           AS pct_revenue
FROM online_orders WHERE financial_status = 'paid' GROUP BY ALL
"""

# --- D ---------------------------------------------------------------------

QUESTIONS["d1_top_products"] = f"""
SELECT i.lineitem_name AS product, {big("sum(i.quantity)")} AS units_sold,
       {dbl("sum(i.quantity * i.price)")} AS revenue, count(DISTINCT o.email) AS unique_buyers,
       {quotient("sum(i.quantity * i.price)", "count(DISTINCT o.email)")} AS revenue_per_buyer
FROM catalog_items i JOIN online_orders o USING (order_name)
WHERE o.financial_status = 'paid' GROUP BY ALL
"""


def pairs(min_together: int) -> str:
    return f"""
SELECT product_in_basket, also_bought, orders_together,
       {rate("orders_together", "n.orders")} AS attach_pct
FROM (SELECT a.lineitem_name AS product_in_basket, b.lineitem_name AS also_bought,
             count(DISTINCT order_name) AS orders_together
      FROM catalog_items a JOIN catalog_items b USING (order_name)
      WHERE a.lineitem_name < b.lineitem_name
      GROUP BY ALL HAVING orders_together >= {min_together})
JOIN (SELECT lineitem_name, count(DISTINCT order_name) AS orders FROM catalog_items
      GROUP BY ALL) n ON n.lineitem_name = product_in_basket
"""


QUESTIONS["d2_attach_rate"] = pairs(5)
QUESTIONS["d3_entry_products"] = f"""
SELECT i.lineitem_name AS product, count(DISTINCT i.order_name) AS first_orders,
       {rate("count(DISTINCT i.order_name)", "(SELECT count(*) FROM buyers)")} AS pct_of_first_orders
FROM buyers b
JOIN online_orders o ON o.email = b.email AND o.created_at = b.first_at
JOIN catalog_items i ON i.order_name = o.order_name
GROUP BY ALL
"""
QUESTIONS["d4_repeat_by_entry_product"] = f"""
SELECT i.lineitem_name AS entry_product, count(DISTINCT b.email) AS first_time_buyers,
       count(DISTINCT b.email) FILTER (b.orders >= 2) AS came_back_again,
       {rate("count(DISTINCT b.email) FILTER (b.orders >= 2)", "count(DISTINCT b.email)")} AS repeat_pct
FROM buyers b
JOIN online_orders o ON o.email = b.email AND o.created_at = b.first_at
JOIN catalog_items i ON i.order_name = o.order_name
GROUP BY ALL
"""
QUESTIONS["d5_product_margin"] = f"""
SELECT v.product_title AS product, {big("sum(i.quantity)")} AS units_sold,
       {dbl("sum(i.quantity * i.price)")} AS revenue,
       {dbl("sum(i.quantity * coalesce(v.cost_per_item, 0))")} AS cogs,
       {dbl("sum(i.quantity * (i.price - coalesce(v.cost_per_item, 0)))")} AS gross_margin,
       {rate("sum(i.quantity * (i.price - coalesce(v.cost_per_item, 0)))",
             "sum(i.quantity * i.price)")} AS gross_margin_pct
FROM catalog_items i
JOIN online_orders o USING (order_name)
JOIN best v ON v.sku IS NOT DISTINCT FROM i.sku
           AND v.lineitem_name IS NOT DISTINCT FROM i.lineitem_name
WHERE o.financial_status = 'paid' GROUP BY ALL
"""
QUESTIONS["d6_zero_sales_variants"] = f"""
SELECT product_title AS product, sku, {dbl("price")} AS listed_price, status
FROM variants v
WHERE status = 'active'
  AND NOT EXISTS (SELECT 1 FROM order_items i WHERE i.sku = v.sku)
  AND NOT EXISTS (SELECT 1 FROM order_items i WHERE i.lineitem_name = v.lineitem_name)
"""

# --- E ---------------------------------------------------------------------

QUESTIONS["e1_basket_size"] = f"""
SELECT {avg("products")} AS avg_distinct_products, {avg("units")} AS avg_units,
       {percentile_columns("v", {"median_units": 50}, PLAIN_PERCENTILE)},
       count(*) FILTER (products = 1) AS single_product_orders,
       count(*) FILTER (products >= 2) AS multi_product_orders
FROM ({ranked('''(SELECT order_name, count(DISTINCT lineitem_name) AS products,
                         CAST(sum(quantity) AS BIGINT) AS units
                  FROM catalog_items GROUP BY order_name)''', "units")})
"""
QUESTIONS["e2_discount_codes"] = f"""
SELECT coalesce(discount_code, '(none)') AS discount_code, count(*) AS orders,
       {dbl("sum(subtotal)")} AS revenue, {dbl("sum(discount_amount)")} AS discount,
       {avg("subtotal")} AS avg_order_value
FROM online_orders o WHERE financial_status = 'paid' GROUP BY o.discount_code
"""
_AVG_DISCOUNT = f"({dbl('sum(discount_amount)')} / count(discount_amount))"
_AVG_FULL = f"({dbl('sum(subtotal + discount_amount)')} / count(subtotal + discount_amount))"
QUESTIONS["e3_discount_depth"] = f"""
SELECT if(discount_code IS NULL, 'No Discount Code', 'Used a Discount Code') AS discount_usage,
       count(*) AS orders, {avg("subtotal")} AS avg_order_value,
       {avg("discount_amount")} AS avg_discount, {rate(_AVG_DISCOUNT, _AVG_FULL)} AS depth_pct
FROM online_orders WHERE financial_status = 'paid' GROUP BY ALL
"""
QUESTIONS["e4_shipping_monthly"] = f"""
SELECT {MONTH.format("created_at")} AS month, count(*) AS paid_orders,
       {dbl("sum(shipping)")} AS shipping_charged, {avg("shipping")} AS avg_shipping,
       count(*) FILTER (shipping = 0) AS free_orders,
       {rate("count(*) FILTER (shipping = 0)", "count(*)")} AS pct_free
FROM online_orders WHERE financial_status = 'paid' GROUP BY ALL
"""
QUESTIONS["e5_refunds"] = f"""
SELECT count(*) AS orders, count(*) FILTER (refunded_amount > 0) AS refunded_orders,
       {rate("count(*) FILTER (refunded_amount > 0)", "count(*)", 2)} AS refund_rate_pct,
       {dbl("sum(refunded_amount)")} AS total_refunded,
       {rate("sum(refunded_amount)", "sum(total)", 2)} AS pct_revenue_refunded
FROM online_orders
"""

# --- F, G ------------------------------------------------------------------

QUESTIONS["f1_channel_mix"] = f"""
SELECT CASE WHEN starts_with(source, 'subscription') THEN 'Subscription'
            WHEN source = 'web' THEN 'One-Time Web'
            WHEN source = 'shopify_draft_order' THEN 'Draft Order (Manual)'
            ELSE 'Other Channel' END AS channel,
       count(*) AS orders, {dbl("sum(subtotal)")} AS revenue, {avg("subtotal")} AS avg_order_value,
       {rate("sum(subtotal)", "(SELECT sum(subtotal) FROM online_orders WHERE financial_status = 'paid')")}
           AS pct_revenue
FROM online_orders WHERE financial_status = 'paid' GROUP BY channel
"""
QUESTIONS["f2_subscriber_ltv"] = f"""
SELECT customer_type, count(*) AS customers, {avg("total_spent")} AS avg_spend,
       {percentile_columns("v", {"median_spend": 50}, MONEY_PERCENTILE)},
       {avg("total_orders")} AS avg_orders
FROM ({ranked('''(SELECT if(s.ever, 'Has Subscribed', 'One-Time Only') AS customer_type,
                         c.total_spent, c.total_orders
                  FROM (SELECT email, bool_or(starts_with(coalesce(source, ''), 'subscription')) AS ever
                        FROM online_orders WHERE email IS NOT NULL GROUP BY email) s
                  JOIN customers c USING (email))''', cents("total_spent"), "customer_type")})
GROUP BY customer_type
"""
QUESTIONS["f3_crossover"] = """
SELECT CASE WHEN web AND sub THEN 'Both Web & Subscription' WHEN sub THEN 'Subscription Only'
            WHEN web THEN 'One-Time Web Only' ELSE 'Other Channels Only' END AS pattern,
       count(*) AS customers
FROM (SELECT bool_or(coalesce(source = 'web', false)) AS web,
             bool_or(starts_with(coalesce(source, ''), 'subscription')) AS sub
      FROM online_orders WHERE email IS NOT NULL GROUP BY email)
GROUP BY ALL
"""
QUESTIONS["g1_state_scorecard"] = f"""
SELECT p.state, p.customers, p.orders, {dbl("p.revenue")} AS revenue,
       {quotient("p.revenue", "p.orders")} AS avg_order_value, r.repeat_customers,
       {rate("r.repeat_customers", "p.customers")} AS repeat_pct
FROM (SELECT shipping_province AS state, count(DISTINCT email) AS customers, count(*) AS orders,
             sum(subtotal) AS revenue
      FROM online_orders WHERE financial_status = 'paid' GROUP BY ALL) p
JOIN (SELECT o.shipping_province AS state,
             count(DISTINCT o.email) FILTER (b.orders >= 2) AS repeat_customers
      FROM online_orders o LEFT JOIN buyers b USING (email) GROUP BY ALL) r USING (state)
"""
QUESTIONS["g2_top_zips"] = f"""
SELECT shipping_zip AS zip_code, shipping_province AS state, count(*) AS orders,
       count(DISTINCT email) AS unique_customers, {dbl("sum(subtotal)")} AS revenue
FROM online_orders WHERE financial_status = 'paid' GROUP BY ALL
ORDER BY sum(subtotal) DESC NULLS LAST, zip_code NULLS LAST, state NULLS LAST LIMIT 20
"""

# --- H, I, J ---------------------------------------------------------------

QUESTIONS["h1_opt_in_rates"] = f"""
SELECT count(*) AS customers, count(*) FILTER (accepts_email_marketing) AS email_opt_ins,
       count(*) FILTER (accepts_sms_marketing) AS sms_opt_ins,
       count(*) FILTER (accepts_email_marketing AND accepts_sms_marketing) AS both_opt_ins,
       {rate("count(*) FILTER (accepts_email_marketing)", "count(*)")} AS email_pct,
       {rate("count(*) FILTER (accepts_sms_marketing)", "count(*)")} AS sms_pct
FROM customers
"""
QUESTIONS["h2_consent_by_ltv"] = f"""
SELECT ['Top 20% (Best Customers)', 'Next 20%', 'Middle 20%', 'Lower 20%', 'Bottom 20%'][tile]
           AS ltv_group,
       count(*) AS customers,
       {rate("count(*) FILTER (accepts_email_marketing)", "count(*)")} AS email_pct,
       {rate("count(*) FILTER (accepts_sms_marketing)", "count(*)")} AS sms_pct
FROM (SELECT *, ntile(5) OVER (ORDER BY total_spent DESC NULLS LAST, customer_id) AS tile
      FROM customers WHERE total_orders >= 1)
GROUP BY tile
"""
QUESTIONS["h3_never_bought"] = """
SELECT count(*) AS subscribers_never_bought FROM customers
WHERE total_orders = 0 AND accepts_email_marketing
"""
_I1_DAYS = DAYS_SINCE.format("b.last_at", AS_OF)
QUESTIONS["i1_recency_segments"] = f"""
SELECT CASE WHEN b.last_at IS NULL THEN '5 - Never Bought Online'
            WHEN {_I1_DAYS} <= 30 THEN '1 - Active (0-30d)'
            WHEN {_I1_DAYS} <= 75 THEN '2 - At Risk (31-75d)'
            WHEN {_I1_DAYS} <= 125 THEN '3 - Dormant (76-125d)'
            ELSE '4 - Lost (126d+)' END AS segment,
       count(*) AS customers, {dbl("sum(c.total_spent)")} AS total_spend,
       {avg("c.total_spent")} AS avg_spend,
       {rate("count(*) FILTER (c.accepts_email_marketing)", "count(*)")} AS email_pct
FROM customers c LEFT JOIN buyers b USING (email) GROUP BY segment
"""
_MONTH_START = "DATE '2001-08-01'"
_THEN = DAYS_SINCE.format("earlier", _MONTH_START)
_NOW = DAYS_SINCE.format("latest", AS_OF)
QUESTIONS["i2_segment_migration"] = f"""
SELECT CASE WHEN earlier IS NULL THEN 'Was New This Month' WHEN {_THEN} <= 30 THEN 'Was Active'
            WHEN {_THEN} <= 75 THEN 'Was At Risk' ELSE 'Was Dormant/Lost' END AS start_segment,
       CASE WHEN {_NOW} <= 30 THEN 'Now Active' WHEN {_NOW} <= 75 THEN 'Now At Risk'
            ELSE 'Now Dormant/Lost' END AS today_segment,
       count(*) AS customers
FROM (SELECT max(created_at) FILTER (created_at < {_MONTH_START}) AS earlier,
             max(created_at) AS latest
      FROM online_orders WHERE email IS NOT NULL GROUP BY email)
GROUP BY ALL
"""
QUESTIONS["j1_contribution_margin"] = f"""
SELECT o.order_name, {dbl("o.subtotal")} AS subtotal, {dbl("o.shipping")} AS shipping,
       {dbl("c.cogs")} AS cogs, {dbl("o.subtotal - c.cogs")} AS product_margin,
       {dbl("o.subtotal + o.shipping - c.cogs")} AS contribution,
       {rate("o.subtotal - c.cogs", "o.subtotal")} AS margin_pct
FROM online_orders o
JOIN (SELECT i.order_name, sum(i.quantity * coalesce(v.cost_per_item, 0)) AS cogs
      FROM order_items i
      JOIN best v ON v.sku IS NOT DISTINCT FROM i.sku
                 AND v.lineitem_name IS NOT DISTINCT FROM i.lineitem_name
      GROUP BY ALL) c USING (order_name)
WHERE o.financial_status = 'paid'
"""

# --- R ---------------------------------------------------------------------

QUESTIONS["r1_top_customer_items"] = f"""
SELECT c.email, {dbl("c.total_spent")} AS total_spent, i.lineitem_name,
       {big("sum(i.quantity)")} AS units
FROM customers c JOIN order_items i USING (email)
WHERE c.total_spent > 1000 GROUP BY c.email, c.total_spent, i.lineitem_name
"""
QUESTIONS["r2_daily_sales"] = f"""
SELECT CAST(created_at AS DATE) AS day, count(*) AS orders, {dbl("sum(total)")} AS revenue,
       {avg("total")} AS avg_order_value
FROM store_orders GROUP BY ALL
"""
QUESTIONS["r3_items_enriched"] = f"""
SELECT i.order_name, i.quantity, i.lineitem_name, {dbl("v.cost_per_item")} AS cost_per_item,
       p.product_category
FROM order_items i
LEFT JOIN variants v USING (lineitem_name)
LEFT JOIN products p ON p.handle = v.handle
"""
