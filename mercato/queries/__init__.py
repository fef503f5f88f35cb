"""The catalogue of business questions, by key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame

from mercato.queries import (
    concentration,
    customer_base,
    economics,
    order_mix,
    products,
    segments,
)
from mercato.store import Store

QUESTIONS: dict[str, Callable[[Store], DataFrame]] = {
    "a1_new_vs_returning_weekly": customer_base.new_vs_returning_weekly,
    "a2_repeat_purchase_rate": customer_base.repeat_purchase_rate,
    "a3_acquisition_curve": customer_base.acquisition_curve,
    "a4_cohort_retention": customer_base.cohort_retention,
    "a5_time_to_second_purchase": customer_base.time_to_second_purchase,
    "b1_aov": economics.average_order_value,
    "b2_aov_monthly": economics.average_order_value_monthly,
    "b3_aov_new_vs_returning": economics.order_value_new_vs_returning,
    "b4_ltv_distribution": economics.lifetime_value_distribution,
    "b5_purchase_frequency": economics.purchase_frequency,
    "c1_revenue_quintiles": concentration.revenue_quintiles,
    "c2_pareto_customers": concentration.customer_pareto,
    "c3_revenue_by_product": concentration.revenue_by_product,
    "c4_revenue_by_variant": concentration.revenue_by_variant,
    "c5_revenue_by_state": concentration.revenue_by_state,
    "d1_top_products": products.top_products,
    "d2_attach_rate": products.attach_rate,
    "d3_entry_products": products.entry_products,
    "d4_repeat_by_entry_product": products.repeat_rate_by_entry_product,
    "d5_product_margin": products.product_margin,
    "d6_zero_sales_variants": products.zero_sales_variants,
    "e1_basket_size": products.basket_size,
    "e2_discount_codes": order_mix.discount_code_usage,
    "e3_discount_depth": order_mix.discount_depth,
    "e4_shipping_monthly": order_mix.shipping_monthly,
    "e5_refunds": order_mix.refunds,
    "f1_channel_mix": order_mix.channel_mix,
    "f2_subscriber_ltv": economics.subscriber_lifetime_value,
    "f3_crossover": economics.channel_crossover,
    "g1_state_scorecard": order_mix.state_scorecard,
    "g2_top_zips": order_mix.top_zips,
    "h1_opt_in_rates": segments.opt_in_rates,
    "h2_consent_by_ltv": segments.consent_by_spend,
    "h3_never_bought": segments.never_bought,
    "j1_contribution_margin": products.contribution_margin,
    "r1_top_customer_items": segments.big_spenders_items,
    "r2_daily_sales": segments.daily_sales,
    "r3_items_enriched": segments.items_with_cost_and_category,
}

# Questions about a given day take that day as a parameter.
DATED_QUESTIONS: dict[str, Callable[[Store, dt.date], DataFrame]] = {
    "a6_reactivation_rate": customer_base.reactivation_rate,
    "b6_rfm": economics.rfm_segments,
    "i1_recency_segments": segments.recency_segments,
    "i2_segment_migration": segments.segment_migration,
}


#: Questions that also have an approximate form: in one aggregate, or from the store's daily sketches.
ONE_AGGREGATE = ("b4_ltv_distribution",)
APPROXIMATE = (*ONE_AGGREGATE, "d1_top_products", "g1_state_scorecard", "g2_top_zips")


def names() -> list[str]:
    return sorted([*QUESTIONS, *DATED_QUESTIONS])


def ask(name: str, store: Store, as_of: dt.date | None = None, approximate: bool = False) -> DataFrame:
    """Run a question; ``as_of`` defaults to today. ``approximate`` is for those in ``APPROXIMATE``."""
    if approximate:
        if name not in APPROXIMATE:
            raise ValueError(f"{name} has no approximate form")
        return QUESTIONS[name](store, approximate=True)
    if name in DATED_QUESTIONS:
        return DATED_QUESTIONS[name](store, as_of or dt.date.today())
    return QUESTIONS[name](store)
