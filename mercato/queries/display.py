"""The questions' columns as users see them."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Column headers of each question, in the order of its columns.
HEADERS = {
    "a1_new_vs_returning_weekly": ("Week", "First-Time Orders", "Returning Orders", "% Returning"),
    "a2_repeat_purchase_rate": ("Customers Who Ever Bought", "Bought 2+ Times", "Repeat-Purchase Rate (%)"),
    "a3_acquisition_curve": ("Acquisition Month", "New Customers"),
    "a4_cohort_retention": (
        "Cohort Month", "Cohort Size", "Months Since First Purchase", "Customers Active", "Retention (%)"),
    "a5_time_to_second_purchase": (
        "Repeat Customers", "Average Days to 2nd Order", "Median Days to 2nd Order", "25th Percentile (Days)",
        "75th Percentile (Days)"),
    "a6_reactivation_rate": (
        "Dormant Customers (30 Days Ago)", "Reactivated in Last 30 Days", "Reactivation Rate (%)"),
    "b1_aov": (
        "Number of Paid Orders", "Average Order Value Before Tax/Shipping ($)",
        "Average Order Value Including Tax/Shipping ($)", "Typical Order Value (Median $)"),
    "b2_aov_monthly": ("Month", "Paid Orders", "Average Order Value ($)", "Typical Order Value ($)"),
    "b3_aov_new_vs_returning": (
        "Customer Type", "Number of Orders", "Average Order Value ($)", "Typical Order Value ($)"),
    "b4_ltv_distribution": (
        "Customers", "Average Lifetime Spend ($)", "Median Lifetime Spend ($)", "75th Percentile ($)",
        "90th Percentile ($)", "95th Percentile ($)", "Highest Lifetime Spend ($)"),
    "b5_purchase_frequency": (
        "Repeat Customers", "Average Orders per Customer", "Orders per Year (Average)",
        "Average Days Between Orders"),
    "b6_rfm": (
        "Recency Score (5=Most Recent)", "Frequency Score (5=Most Frequent)",
        "Spending Score (5=Highest Spender)", "Customers in This Group", "Average Lifetime Spend ($)"),
    "c1_revenue_quintiles": ("Customer Group", "Customers", "Lifetime Revenue ($)", "% of All Revenue"),
    "c2_pareto_customers": ("% of Customers (Cumulative)", "% of Revenue (Cumulative)"),
    "c3_revenue_by_product": ("Product", "Product Revenue ($)", "% of Revenue", "Cumulative % of Revenue"),
    "c4_revenue_by_variant": ("SKU", "Product / Variant", "Units Sold", "Revenue ($)"),
    "c5_revenue_by_state": ("State", "Orders", "Revenue ($)", "% of Revenue"),
    "d1_top_products": ("Product", "Units Sold", "Revenue ($)", "Unique Buyers", "Revenue per Buyer ($)"),
    "d2_attach_rate": ("Product in Basket", "Also Bought", "Orders Together", "Attach Rate (%)"),
    "d3_entry_products": ("Product", "First Orders Containing It", "% of All First Orders"),
    "d4_repeat_by_entry_product": ("Entry Product", "First-Time Buyers", "Came Back Again", "Repeat Rate (%)"),
    "d5_product_margin": (
        "Product", "Units Sold", "Revenue ($)", "COGS ($)", "Gross Margin ($)", "Gross Margin (%)"),
    "d6_zero_sales_variants": ("Product", "SKU", "Listed Price ($)", "Status"),
    "e1_basket_size": (
        "Avg Distinct Products per Order", "Avg Units per Order", "Typical Units per Order (Median)",
        "Single-Product Orders", "Multi-Product Orders"),
    "e2_discount_codes": (
        "Discount Code", "Orders Using Code", "Revenue from These Orders ($)", "Total Discount Given ($)",
        "Average Order Value ($)"),
    "e3_discount_depth": (
        "Discount Usage", "Orders", "Average Order Value ($)", "Average Discount ($)", "Discount Depth (%)"),
    "e4_shipping_monthly": (
        "Month", "Paid Orders", "Shipping Charged ($)", "Avg Shipping per Order ($)", "Free-Shipping Orders",
        "% Orders Shipped Free"),
    "e5_refunds": (
        "Orders", "Orders with a Refund", "Refund Rate (%)", "Total Refunded ($)", "% of Revenue Refunded"),
    "f1_channel_mix": ("Channel", "Orders", "Revenue ($)", "Average Order Value ($)", "% of Revenue"),
    "f2_subscriber_ltv": (
        "Customer Type", "Customers", "Average Lifetime Spend ($)", "Median Lifetime Spend ($)",
        "Average Lifetime Orders"),
    "f3_crossover": ("Purchase Pattern", "Customers"),
    "g1_state_scorecard": (
        "State", "Customers", "Orders", "Revenue ($)", "Average Order Value ($)", "Repeat Customers",
        "% of Customers Who Repeat"),
    "g2_top_zips": ("ZIP Code", "State", "Orders", "Unique Customers", "Revenue ($)"),
    "h1_opt_in_rates": (
        "Customers", "Email Opt-Ins", "SMS Opt-Ins", "Both Email & SMS", "Email Opt-In Rate (%)",
        "SMS Opt-In Rate (%)"),
    "h2_consent_by_ltv": ("LTV Group", "Customers", "Email Opt-In Rate (%)", "SMS Opt-In Rate (%)"),
    "h3_never_bought": ("Subscribers Who Never Bought",),
    "i1_recency_segments": (
        "Segment", "Customers", "Total Lifetime Spend ($)", "Average Lifetime Spend ($)",
        "Email Opt-In Rate (%)"),
    "i2_segment_migration": ("Segment at Start of Month", "Segment Today", "Customers"),
    "j1_contribution_margin": (
        "Order", "Subtotal ($)", "Shipping Charged ($)", "COGS ($)", "Product Margin ($)",
        "Contribution incl. Shipping ($)", "Margin (%)"),
}


def with_headers(name: str, result: DataFrame) -> DataFrame:
    """A question's result under the headers that users see; others keep their names."""
    return result.toDF(*HEADERS.get(name, result.columns))
