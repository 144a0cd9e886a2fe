"""Where and why deliveries are late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.buckets import (
    DELAY_BOUNDS,
    DELAY_LABELS,
    WEIGHT_BOUNDS,
    WEIGHT_LABELS,
    bucket_label,
    bucket_order,
)
from orderlens.functions.exact import (
    exact_mean,
    exact_sum,
    half_up,
    percent,
)
from orderlens.operators.order_stats import with_tiles
from orderlens.plans.common import (
    delivered,
    delivered_dated,
    late_pct,
    mean_days,
    mean_late_delay,
    mean_review,
    orders,
    with_state,
    whole,
)

# Names of the seller tiers.
SELLER_TIERS = (
    "Q1 - Best (lowest delay rate)",
    "Q2 - Good",
    "Q3 - Below Average",
    "Q4 - Worst (highest delay rate)",
)


def delay_distribution(star) -> DataFrame:
    grouped = (
        delivered(star.fact)
        .where(F.col("delivery_delay_days").isNotNull())
        .groupBy(bucket_order(F.col("delivery_delay_days"), DELAY_BOUNDS).alias("bucket"))
        .agg(F.count("*").alias("item_count"), mean_review().alias("avg_review_in_bucket"))
    )
    share = percent(F.col("item_count"), F.sum("item_count").over(whole()))
    return (
        grouped.withColumn("pct_of_total", half_up(share, 1))
        .orderBy("bucket")
        .select(
            bucket_label(F.col("bucket"), DELAY_LABELS).alias("delay_bucket"),
            "item_count", "pct_of_total", "avg_review_in_bucket",
        )
    )


def delay_by_state(star, min_orders: int = 100, rows: int = 15) -> DataFrame:
    return (
        with_state(delivered_dated(star.fact), star.customers)
        .groupBy("customer_state")
        .agg(
            orders().alias("orders"),
            mean_days("delivery_days").alias("avg_delivery_days"),
            mean_days("estimated_delivery_days").alias("avg_estimated_days"),
            mean_days("delivery_delay_days").alias("avg_delay_days"),
            late_pct().alias("late_pct"),
            mean_review().alias("avg_review"),
            mean_late_delay().alias("avg_late_delay"),
        )
        .where(F.col("orders") >= min_orders)
        .orderBy(F.desc("late_pct"), "customer_state")
        .limit(rows)
    )


def delay_by_category(star, min_orders: int = 50, rows: int = 15) -> DataFrame:
    traits = star.products.select(
        "product_id", "product_category", "product_weight_g", "product_volume_cm3"
    )
    return (
        delivered_dated(star.fact)
        .join(traits, "product_id")
        .groupBy("product_category")
        .agg(
            orders().alias("orders"),
            mean_days("delivery_days").alias("avg_delivery_days"),
            mean_days("delivery_delay_days").alias("avg_delay_days"),
            late_pct().alias("late_pct"),
            mean_review().alias("avg_review"),
            half_up(exact_mean("product_weight_g"), 0).alias("avg_weight_g"),
            half_up(F.avg("product_volume_cm3"), 0).alias("avg_volume_cm3"),
        )
        .where(F.col("orders") >= min_orders)
        .orderBy(F.desc("late_pct"), "product_category")
        .limit(rows)
    )


def delay_by_seller_tier(star, min_orders: int = 5) -> DataFrame:
    """Sellers in four equal tiers of late rate (ties by id); tier means weigh sellers equally."""
    per_seller = (
        delivered_dated(star.fact)
        .groupBy("seller_id")
        .agg(
            orders().alias("orders"),
            F.avg("is_late").alias("late_rate"),
            exact_mean("delivery_days").alias("delivery"),
            F.avg("review_score").alias("review"),
            exact_sum("total_item_value").alias("revenue"),
        )
        .where(F.col("orders") >= min_orders)
    )
    tiered = with_tiles(per_seller, {"tier": (4, ["late_rate", "seller_id"])}, "seller_tiers")
    return (
        tiered.groupBy("tier")
        .agg(
            F.count("*").alias("seller_count"),
            half_up(F.avg("late_rate") * F.lit(100.0), 1).alias("avg_late_pct"),
            half_up(F.avg("delivery"), 1).alias("avg_delivery_days"),
            half_up(F.avg("review"), 2).alias("avg_review"),
            exact_sum("revenue").alias("total_revenue"),
            half_up(F.avg("orders"), 0).alias("avg_orders_per_seller"),
        )
        .orderBy("tier")
        .withColumn("seller_tier", bucket_label(F.col("tier"), SELLER_TIERS))
        .select(
            "seller_tier", "seller_count", "avg_late_pct", "avg_delivery_days", "avg_review",
            "total_revenue", "avg_orders_per_seller",
        )
    )


def _by_calendar(star, *columns: str) -> DataFrame:
    return (
        delivered_dated(star.fact)
        .join(
            star.dates.select(F.col("date_key").alias("order_date_key"), *columns),
            "order_date_key",
        )
        .groupBy(*columns)
        .agg(
            orders().alias("orders"),
            mean_days("delivery_days").alias("avg_delivery_days"),
            late_pct().alias("late_pct"),
            mean_review().alias("avg_review"),
        )
    )


def delay_seasonality(star) -> DataFrame:
    return _by_calendar(star, "month", "month_name").orderBy("month")


def delay_by_weekday(star) -> DataFrame:
    return _by_calendar(star, "day_name", "day_of_week").orderBy("day_of_week")


def delay_corridors(star, min_orders: int = 50, rows: int = 20) -> DataFrame:
    """Seller state to customer state, compared with the mean over all dated deliveries."""
    overall = delivered_dated(star.fact).agg(exact_mean("delivery_days")).scalar()
    return (
        with_state(delivered_dated(star.fact), star.customers)
        .join(star.sellers.select("seller_id", "seller_state"), "seller_id")
        .groupBy(F.col("seller_state").alias("from_state"), F.col("customer_state").alias("to_state"))
        .agg(
            orders().alias("orders"),
            exact_mean("delivery_days").alias("mean_days"),
            mean_days("delivery_delay_days").alias("avg_delay_days"),
            late_pct().alias("late_pct"),
            mean_review().alias("avg_review"),
        )
        .where(F.col("orders") >= min_orders)
        .orderBy(F.desc("late_pct"), "from_state", "to_state")
        .limit(rows)
        .select(
            "from_state", "to_state", "orders",
            half_up(F.col("mean_days"), 1).alias("avg_delivery_days"),
            "avg_delay_days", "late_pct", "avg_review",
            half_up(F.col("mean_days") - overall, 1).alias("days_above_avg"),
        )
        .orderBy(F.desc("late_pct"), "from_state", "to_state")
    )


def delay_by_weight(star) -> DataFrame:
    weights = star.products.select("product_id", "product_weight_g").where(
        F.col("product_weight_g").isNotNull()
    )
    bucket = bucket_order(F.col("product_weight_g"), WEIGHT_BOUNDS)
    return (
        delivered_dated(star.fact)
        .join(weights, "product_id")
        .groupBy(bucket_label(bucket, WEIGHT_LABELS).alias("weight_bucket"))
        .agg(
            orders().alias("orders"),
            mean_days("delivery_days").alias("avg_delivery_days"),
            mean_days("delivery_delay_days").alias("avg_delay_days"),
            late_pct().alias("late_pct"),
            mean_review().alias("avg_review"),
        )
        .orderBy("weight_bucket")
    )
