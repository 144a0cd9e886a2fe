"""Dashboard extracts, key figures and workbook pivots.

Extracts use delivered items, leave rows without a group key out and round half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.exact import exact_mean, exact_sum, half_even, hundredths
from orderlens.plans.common import (
    delivered,
    month_start,
    orders,
    per_month,
    with_category,
    with_state,
    year_month,
    whole,
)

# On-time rates (in percent) from which a month counts as yellow or green.
YELLOW_FROM, GREEN_ABOVE = 80.0, 90.0


def _review() -> Column:
    return half_even(F.avg("review_score"))


def _late_rate() -> Column:
    return half_even(F.avg("is_late"))


def monthly_kpis(star) -> DataFrame:
    """Note that `avg_order_value` is a mean over items, as the dashboard defines it."""
    return per_month(
        delivered(star.fact).where(F.col("order_date_key").isNotNull()),
        exact_sum("total_item_value").alias("total_gmv"),
        orders().alias("total_orders"),
        half_even(exact_mean("total_item_value")).alias("avg_order_value"),
        half_even(F.lit(1.0) - F.avg("is_late")).alias("on_time_rate"),
        half_even(exact_mean("delivery_days")).alias("avg_delivery_days"),
        _review().alias("avg_review_score"),
    ).orderBy("year_month")


def category_breakdown(star, category: str | None = None) -> DataFrame:
    """By category, largest revenue first; `category` keeps one category only."""
    items = with_category(delivered(star.fact), star.products)
    if category is not None:
        items = items.where(F.col("product_category") == category)
    return (
        items.where(F.col("product_category").isNotNull())
        .groupBy("product_category")
        .agg(
            exact_sum("total_item_value").alias("revenue"),
            orders().alias("order_count"),
            _review().alias("avg_review"),
            _late_rate().alias("late_rate"),
        )
        .orderBy(F.desc("revenue"), "product_category")
    )


def regional_delivery(star, state: str | None = None) -> DataFrame:
    """By customer state, most orders first; `state` keeps one state only."""
    items = with_state(delivered(star.fact), star.customers)
    if state is not None:
        items = items.where(F.col("customer_state") == state)
    return (
        items.where(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            orders().alias("total_orders"),
            half_even(exact_mean("delivery_days")).alias("avg_delivery_days"),
            _late_rate().alias("late_rate"),
            _review().alias("avg_review"),
            exact_sum("total_item_value").alias("total_revenue"),
        )
        .orderBy(F.desc("total_orders"), "customer_state")
    )


def seller_leaderboard(star, rows: int = 50) -> DataFrame:
    return star.sellers.orderBy(F.desc_nulls_last("total_revenue"), "seller_id").limit(rows)


def extracts(star) -> dict[str, DataFrame]:
    """The four dashboard extracts by file name."""
    return {
        "monthly_kpis": monthly_kpis(star),
        "category_breakdown": category_breakdown(star),
        "regional_delivery": regional_delivery(star),
        "seller_leaderboard": seller_leaderboard(star),
    }


def kpi_cards(monthly: DataFrame) -> DataFrame:
    """Key figures from the monthly extract: rates and scores weigh every month equally."""
    return monthly.agg(
        exact_sum("total_gmv").alias("total_gmv"),
        F.sum("total_orders").alias("total_orders"),
        (exact_mean("on_time_rate") * F.lit(100.0)).alias("avg_on_time_pct"),
        exact_mean("avg_review_score").alias("avg_review"),
        exact_mean("avg_order_value").alias("avg_aov"),
    ).select(
        "total_gmv",
        "total_orders",
        *[F.round(c, 6).alias(c) for c in ("avg_on_time_pct", "avg_review", "avg_aov")],
    )


def top_categories(breakdown: DataFrame, rows: int = 10) -> DataFrame:
    return breakdown.orderBy(F.desc("revenue"), "product_category").limit(rows)


def top_states(regional: DataFrame, rows: int = 10) -> DataFrame:
    return regional.orderBy(F.desc("total_orders"), "customer_state").limit(rows)


def top_sellers(leaderboard: DataFrame, rows: int = 10) -> DataFrame:
    return (
        leaderboard.orderBy(F.desc_nulls_last("total_revenue"), "seller_id")
        .limit(rows)
        .select("seller_id", "seller_city", "seller_state", "total_revenue", "avg_review_score")
    )


def category_share(breakdown: DataFrame) -> DataFrame:
    """Share of each category in the revenue of all; empty when there is no revenue."""
    total = F.sum(hundredths("revenue")).over(whole()) / F.lit(100.0)
    share = F.try_divide(F.col("revenue"), total)
    return breakdown.select(
        "product_category", "revenue", F.round(share, 6).alias("revenue_share")
    )


def ontime_band(monthly: DataFrame) -> DataFrame:
    rate = F.rint(F.col("on_time_rate") * F.lit(100.0))
    return monthly.select(
        "year_month",
        "on_time_rate",
        F.when(rate > GREEN_ABOVE, "green")
        .when(rate >= YELLOW_FROM, "yellow")
        .when(rate.isNotNull(), "red")
        .alias("band"),
    )


def leaderboard_by_state(leaderboard: DataFrame) -> DataFrame:
    return (
        leaderboard.groupBy("seller_state")
        .agg(exact_sum("total_revenue").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "seller_state")
    )


def pivot_monthly(star) -> DataFrame:
    """Workbook pivot: counts item rows, not distinct orders."""
    return per_month(
        delivered(star.fact),
        exact_sum("total_item_value").alias("total_gmv"),
        F.count("order_id").alias("order_count"),
        F.round(exact_mean("total_item_value"), 6).alias("aov"),
    ).orderBy("year_month")


def pivot_category(star) -> DataFrame:
    """Workbook pivot over all items, whatever their status."""
    return (
        with_category(star.fact, star.products, "left")
        .groupBy("product_category")
        .agg(
            exact_sum("total_item_value").alias("revenue"),
            F.round(F.avg("review_score"), 6).alias("avg_review"),
            F.round(F.avg("is_late"), 6).alias("late_rate"),
        )
        .orderBy(F.desc("revenue"), "product_category")
    )


def pivot_state(star) -> DataFrame:
    return (
        with_state(star.fact, star.customers, "left")
        .groupBy("customer_state")
        .agg(
            F.count("order_id").alias("order_count"),
            F.round(exact_mean("delivery_days"), 6).alias("avg_delivery_days"),
            F.round(F.avg("is_late"), 6).alias("late_rate"),
            F.round(F.avg("review_score"), 6).alias("avg_review"),
        )
        .orderBy("customer_state")
    )


def pivot_seller(star, top: int = 10) -> DataFrame:
    """Workbook pivot of all sellers, flagging those ranked within the first `top`.

    A seller ranks within the top n exactly when its revenue reaches the n-th largest, so one
    threshold replaces a rank over all sellers.
    """

    def grouped() -> DataFrame:
        return star.fact.groupBy("seller_id").agg(
            exact_sum("total_item_value").alias("revenue"),
            F.count("order_id").alias("order_count"),
            F.round(F.avg("review_score"), 6).alias("avg_review"),
        )

    best = grouped().select("revenue").orderBy(F.desc_nulls_last("revenue")).limit(top)
    threshold = best.agg(F.min("revenue")).scalar()
    flag = F.coalesce((F.col("revenue") >= threshold).cast("int"), F.lit(0))
    return grouped().withColumn("is_top10", flag).orderBy(F.desc("revenue"), "seller_id")


def pivot_cards(star) -> DataFrame:
    """Workbook key figures over all items, delivered or not."""
    gmv = exact_sum("total_item_value")
    return star.fact.agg(
        gmv.alias("total_gmv"),
        orders().alias("total_orders"),
        F.round(F.try_divide(gmv, orders()), 6).alias("aov"),
        F.round(F.lit(1.0) - F.avg("is_late"), 6).alias("on_time_rate"),
    )


def conditional_aggs(star) -> DataFrame:
    """Conditional sum, mean and count per state: delivered revenue, days of late items, orders."""
    done, late = F.col("is_delivered") == 1, F.col("is_late") == 1
    return (
        with_state(star.fact, star.customers)
        .groupBy("customer_state")
        .agg(
            exact_sum(F.when(done, F.col("total_item_value"))).alias("revenue_if"),
            F.round(exact_mean(F.when(late, F.col("delivery_days"))), 6).alias(
                "avg_late_delivery_days"
            ),
            F.count_if(done).alias("orders_if"),
        )
        .orderBy("customer_state")
    )


def high_risk_flags(star, estimate_over: float = 30.0) -> DataFrame:
    """Late items promised more than `estimate_over` days ahead, counted per month."""
    flag = F.when(
        (F.col("is_late") == 1) & (F.col("estimated_delivery_days") > estimate_over), 1
    ).otherwise(0)
    return (
        star.fact.groupBy(month_start().alias("month_start"), flag.alias("high_risk_flag"))
        .agg(F.count("*").alias("items"))
        .select(year_month(), "high_risk_flag", "items")
        .orderBy("year_month", "high_risk_flag")
    )


def delivery_percentiles(star) -> DataFrame:
    """Exact percentiles; day counts have two decimals, so their distinct values are few."""
    days = (
        delivered(star.fact)
        .where(F.col("delivery_days").isNotNull())
        .groupBy("delivery_days")
        .agg(F.count("*").alias("n"))
    )
    return days.agg(
        *[
            F.round(F.percentile("delivery_days", p, F.col("n")), 6).alias(name)
            for name, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))
        ]
    )
