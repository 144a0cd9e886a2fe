"""Business metrics over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.functions.exact import (
    exact_mean,
    exact_sum,
    half_up,
    hundredths,
    percent,
)
from orderlens.plans.common import (
    delivered,
    delivered_dated,
    late_pct,
    mean_days,
    mean_late_delay,
    mean_review,
    month_start,
    orders,
    per_month,
    with_category,
    with_state,
    year_month,
    whole,
)


def gmv_overall(star) -> DataFrame:
    return delivered(star.fact).agg(
        orders().alias("total_orders"),
        exact_sum("total_item_value").alias("total_gmv"),
        exact_sum("price").alias("total_product_revenue"),
        exact_sum("freight_value").alias("total_freight_revenue"),
        half_up(exact_mean("total_item_value"), 2).alias("avg_order_item_value"),
    )


def gmv_monthly(star) -> DataFrame:
    """Monthly revenue and its growth over the previous month that has orders."""
    monthly = per_month(
        delivered(star.fact),
        orders().alias("orders"),
        exact_sum("total_item_value").alias("gmv"),
        half_up(exact_mean("total_item_value"), 2).alias("avg_item_value"),
    )
    previous = F.lag("gmv").over(W.orderBy("year_month"))
    growth = F.try_divide(F.col("gmv") - previous, previous) * F.lit(100.0)
    return monthly.withColumn("mom_growth_pct", half_up(growth, 1)).orderBy("year_month")


def aov(star) -> DataFrame:
    """Order value statistics.  The deviation compares the mean with itself and is zero."""
    totals = delivered(star.fact).groupBy("order_id").agg(
        F.sum(hundredths("total_item_value")).alias("cents")
    )
    mean = F.try_divide(F.sum("cents") / F.lit(100.0), F.count("cents"))
    return totals.agg(
        F.count("*").alias("total_orders"),
        half_up(mean, 2).alias("aov"),
        (F.min("cents") / F.lit(100.0)).alias("min_order"),
        (F.max("cents") / F.lit(100.0)).alias("max_order"),
        half_up(mean - mean, 2).alias("deviation_from_mean"),
    )


def repeat_rate(star) -> DataFrame:
    per_customer = delivered(star.fact).groupBy("customer_unique_id").agg(
        orders().alias("order_count")
    )
    repeats = F.count_if(F.col("order_count") > 1)
    return per_customer.agg(
        F.count("*").alias("total_customers"),
        repeats.alias("repeat_customers"),
        half_up(percent(repeats, F.count("*")), 2).alias("repeat_purchase_rate_pct"),
        half_up(F.avg("order_count"), 2).alias("avg_orders_per_customer"),
        F.max("order_count").alias("max_orders_by_customer"),
    )


def _top_by_revenue(grouped: DataFrame, tie: str, rows: int) -> DataFrame:
    """The `rows` groups of largest revenue with their rank.

    A rank depends only on groups with more revenue, and those are all among the first
    rows, so ranking after the limit gives the same rank as ranking every group.
    """
    top = grouped.orderBy(F.desc("revenue"), tie).limit(rows)
    rank = F.rank().over(W.orderBy(F.desc("revenue")))
    return top.withColumn("revenue_rank", rank).orderBy(F.desc("revenue"), tie)


def category_rank(star, rows: int = 20) -> DataFrame:
    grouped = (
        with_category(delivered(star.fact), star.products)
        .groupBy("product_category")
        .agg(
            orders().alias("orders"),
            exact_sum("total_item_value").alias("revenue"),
            mean_review().alias("avg_review"),
            late_pct().alias("late_delivery_pct"),
        )
    )
    return _top_by_revenue(grouped, "product_category", rows)


def delivery_performance(star) -> DataFrame:
    on_time = F.count_if(F.col("is_late") == 0)
    return delivered_dated(star.fact).agg(
        orders().alias("delivered_orders"),
        on_time.alias("on_time_items"),
        F.count_if(F.col("is_late") == 1).alias("late_items"),
        half_up(percent(on_time, F.count("*")), 2).alias("on_time_rate_pct"),
        mean_days("delivery_days").alias("avg_delivery_days"),
        mean_days("delivery_delay_days").alias("avg_delay_days"),
        mean_late_delay().alias("avg_late_delay_days"),
    )


def delivery_by_state(star) -> DataFrame:
    return (
        with_state(delivered_dated(star.fact), star.customers)
        .groupBy("customer_state")
        .agg(
            orders().alias("orders"),
            mean_days("delivery_days").alias("avg_delivery_days"),
            late_pct().alias("late_pct"),
            mean_late_delay().alias("avg_late_delay"),
            mean_review().alias("avg_review"),
        )
        .orderBy(F.desc("late_pct"), "customer_state")
    )


def seller_rank(star, rows: int = 20) -> DataFrame:
    """Best sellers by delivered value including freight.

    Sellers are aggregated and cut to the top rows by id before their address is looked up.
    """
    known = star.sellers.select("seller_id")
    grouped = delivered(star.fact).groupBy("seller_id").agg(
        orders().alias("orders"),
        F.count("order_item_id").alias("items_sold"),
        exact_sum("total_item_value").alias("revenue"),
        mean_review().alias("avg_review"),
        late_pct().alias("late_pct"),
        mean_days("delivery_days").alias("avg_delivery_days"),
    )
    top = _top_by_revenue(grouped.join(known, "seller_id", "left_semi"), "seller_id", rows)
    address = star.sellers.select("seller_id", "seller_city", "seller_state")
    return (
        top.join(address, "seller_id")
        .select(
            "seller_id", "seller_city", "seller_state", "orders", "items_sold", "revenue",
            "avg_review", "late_pct", "avg_delivery_days", "revenue_rank",
        )
        .orderBy(F.desc("revenue"), "seller_id")
    )


def payment_breakdown(star) -> DataFrame:
    """By payment type, orders without payment included.

    An order has one payment type, so the orders of all types add up to all orders and the
    share needs no second scan.
    """
    grouped = delivered(star.fact).groupBy("payment_type").agg(
        orders().alias("orders"),
        exact_sum("total_item_value").alias("revenue"),
        half_up(F.avg("payment_installments"), 1).alias("avg_installments"),
    )
    share = percent(F.col("orders"), F.sum("orders").over(whole()))
    return grouped.withColumn("pct_of_orders", half_up(share, 1)).orderBy(
        F.desc("orders"), "payment_type"
    )


def new_vs_returning(star) -> DataFrame:
    """Customers per month, split by whether it is their first month.

    Rows are reduced to one per customer and month before the first month is taken, so a
    customer contributes at most as many rows as there are months.
    """
    active = (
        delivered(star.fact)
        .where(F.col("customer_unique_id").isNotNull())
        .select("customer_unique_id", month_start().alias("month_start"))
        .distinct()
    )
    first = F.min("month_start").over(W.partitionBy("customer_unique_id"))
    is_new = F.col("month_start") == F.col("first_month")
    monthly = (
        active.withColumn("first_month", first)
        .groupBy("month_start")
        .agg(
            F.count("*").alias("total_customers"),
            F.count_if(is_new).alias("new_customers"),
            F.count_if(~is_new).alias("returning_customers"),
            half_up(percent(F.count_if(~is_new), F.count("*")), 1).alias("returning_pct"),
        )
    )
    return monthly.select(
        year_month(), "total_customers", "new_customers", "returning_customers", "returning_pct"
    ).orderBy("year_month")
