"""Exploratory figures: the data behind each chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.buckets import (
    DELAY_BOUNDS,
    DELAY_CHART_LABELS,
    bucket_label,
    bucket_order,
)
from orderlens.functions.exact import exact_mean, exact_sum, half_up, hundredths, percent
from orderlens.plans.common import (
    delivered,
    delivered_dated,
    orders,
    per_month,
    with_category,
    with_state,
)
from orderlens.plans.star import FACT_COLUMNS

# The numeric columns compared with each other.
CORRELATED = (
    "price", "freight_value", "total_item_value", "delivery_days", "estimated_delivery_days",
    "delivery_delay_days", "review_score", "payment_installments", "review_comment_length",
)


def overview(star) -> DataFrame:
    """One row of totals; the dimension sizes are scalar subqueries."""
    done = F.col("is_delivered") == 1
    value = F.when(done, F.col("total_item_value"))

    def size(dim: DataFrame) -> Column:
        return dim.agg(F.count("*")).scalar()

    return star.fact.agg(
        F.count("*").alias("total_items"),
        F.count_if(done).alias("delivered_items"),
        orders().alias("unique_orders"),
        F.date_format(F.min("order_purchase_timestamp"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("order_purchase_timestamp"), "yyyy-MM-dd").alias("last_date"),
        exact_sum(value).alias("total_gmv"),
        half_up(exact_mean(value), 2).alias("avg_item_value"),
    ).select(
        "*",
        size(star.customers).alias("unique_customers"),
        size(star.products).alias("unique_products"),
        size(star.sellers).alias("unique_sellers"),
    )


def null_profile(star) -> DataFrame:
    """Nulls per fact column, columns without nulls left out; one pass over the table."""
    counted = star.fact.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in FACT_COLUMNS],
    )
    return (
        counted.unpivot("total", list(FACT_COLUMNS), "column", "nulls")
        .where("nulls > 0")
        .select("column", "nulls", half_up(percent(F.col("nulls"), F.col("total")), 1).alias("pct"))
        .orderBy("column")
    )


def trend_monthly(star) -> DataFrame:
    return per_month(
        delivered(star.fact),
        orders().alias("orders"),
        exact_sum("total_item_value").alias("gmv"),
    ).orderBy("year_month")


def _top_revenue(items: DataFrame, key: str, rows: int) -> DataFrame:
    return (
        items.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(exact_sum("total_item_value").alias("revenue"))
        .orderBy(F.desc("revenue"), key)
        .limit(rows)
    )


def category_top(star, rows: int = 15) -> DataFrame:
    # Revenue is summed per product before the category is looked up.
    return _top_revenue(
        with_category(_revenue_per(star, "product_id"), star.products), "product_category", rows
    )


def state_top(star, rows: int = 15) -> DataFrame:
    return _top_revenue(
        with_state(_revenue_per(star, "customer_unique_id"), star.customers),
        "customer_state",
        rows,
    )


def _revenue_per(star, key: str) -> DataFrame:
    return (
        delivered(star.fact)
        .groupBy(key)
        .agg(exact_sum("total_item_value").alias("total_item_value"))
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """`bins` equal bins between the smallest and largest value, the last one closed.

    Values are binned as whole hundredths, so an edge never depends on rounding.  Empty bins
    are listed with a count of zero.
    """
    cents = hundredths(value)
    # Counting distinct values first leaves little to bin.
    counts = df.where(value.isNotNull()).groupBy(cents.alias("v")).agg(F.count("*").alias("n"))
    limits = counts.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    at = F.expr("(v - limits.lo) * bins div nullif(limits.hi - limits.lo, 0)")
    placed = (
        counts.withColumns({"limits": limits, "bins": F.lit(bins)})
        .groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).alias("bin"))
        .agg(F.sum("n").alias("count"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"), limits.alias("limits"))

    def edge(index: Column) -> Column:
        width = (F.col("limits.hi") - F.col("limits.lo")) / F.lit(100.0 * bins)
        return F.round(F.col("limits.lo") / F.lit(100.0) + index * width, 6)

    return (
        every.where(F.col("limits.lo").isNotNull())
        .join(placed, "bin", "left")
        .select(
            "bin",
            edge(F.col("bin")).alias("lower"),
            edge(F.col("bin") + 1).alias("upper"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )


def _clip(name: str, low: float, high: float) -> Column:
    c = F.col(name)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def hist_delivery_days(star) -> DataFrame:
    dated = delivered_dated(star.fact)
    per_value = dated.groupBy("delivery_days").agg(F.count("*").alias("n"))
    median = per_value.agg(F.percentile("delivery_days", 0.5, F.col("n"))).scalar()
    bins = histogram(dated, _clip("delivery_days", 0.0, 60.0), 40)
    return bins.withColumn("median", F.round(median, 6))


def hist_delay_days(star) -> DataFrame:
    return histogram(
        delivered_dated(star.fact), _clip("delivery_delay_days", -30.0, 30.0), 50
    )


def ontime_split(star) -> DataFrame:
    return (
        delivered_dated(star.fact)
        .groupBy("is_late")
        .agg(F.count("*").alias("count"))
        .orderBy("is_late")
    )


def _reviewed(star) -> DataFrame:
    return delivered(star.fact).where(F.col("review_score").isNotNull())


def review_counts(star) -> DataFrame:
    return (
        _reviewed(star)
        .groupBy("review_score")
        .agg(F.count("*").alias("count"))
        .orderBy("review_score")
    )


def review_by_late(star) -> DataFrame:
    """Score counts by lateness with the mean of each side, from one small count table."""
    counts = _reviewed(star).groupBy("is_late", "review_score").agg(F.count("*").alias("count"))
    means = counts.groupBy("is_late").agg(
        F.round(
            F.sum(F.col("review_score") * F.col("count")) / F.sum("count"), 6
        ).alias("mean_review")
    )
    return counts.join(means, "is_late").orderBy("is_late", "review_score")


def review_by_delay_bucket(star) -> DataFrame:
    return (
        _reviewed(star)
        .where(F.col("delivery_delay_days").isNotNull())
        .groupBy(bucket_order(F.col("delivery_delay_days"), DELAY_BOUNDS).alias("bucket_order"))
        .agg(F.round(F.avg("review_score"), 6).alias("avg_review"))
        .select(
            bucket_label(F.col("bucket_order"), DELAY_CHART_LABELS).alias("delay_bucket"),
            "bucket_order",
            "avg_review",
        )
        .orderBy("bucket_order")
    )


def payments(star) -> DataFrame:
    """Orders and revenue per payment type; orders without payment are left out."""
    return (
        delivered(star.fact)
        .where(F.col("payment_type").isNotNull())
        .groupBy("payment_type")
        .agg(orders().alias("orders"), exact_sum("total_item_value").alias("revenue"))
        .orderBy(F.desc("orders"), "payment_type")
    )


def payments_top(star, rows: int = 5) -> DataFrame:
    return payments(star).select("payment_type", "orders").limit(rows)


def seller_metrics(star) -> DataFrame:
    """Per seller; a seller is reduced to one row before the state is joined."""
    return (
        delivered(star.fact)
        .where(F.col("seller_id").isNotNull())
        .groupBy("seller_id")
        .agg(
            exact_sum("total_item_value").alias("revenue"),
            orders().alias("orders"),
            F.round(F.avg("review_score"), 6).alias("avg_review"),
            F.avg("is_late").alias("late_rate"),
        )
        .join(star.sellers.select("seller_id", "seller_state"), "seller_id", "left")
        .withColumn("late_rate", F.round("late_rate", 6))
    )


def hist_seller_revenue(star) -> DataFrame:
    return histogram(seller_metrics(star), F.col("revenue"), 50)


def hist_seller_orders(star) -> DataFrame:
    return histogram(seller_metrics(star), _clip("orders", 0.0, 100.0), 40)


def seller_states_top(star, rows: int = 10) -> DataFrame:
    return (
        seller_metrics(star)
        .where(F.col("seller_state").isNotNull())
        .groupBy("seller_state")
        .agg(F.count("*").alias("sellers"))
        .orderBy(F.desc("sellers"), "seller_state")
        .limit(rows)
    )


def seller_scatter(star, min_orders: int = 5) -> DataFrame:
    return (
        seller_metrics(star)
        .where(F.col("orders") >= min_orders)
        .select(
            "seller_id",
            F.round(F.col("late_rate") * F.lit(100.0), 4).alias("late_pct"),
            "avg_review",
            F.round(F.log10(F.col("revenue") + 1), 6).alias("log10_revenue"),
        )
    )


def seller_quality_gate(star, late_over: float = 0.15) -> DataFrame:
    return (
        seller_metrics(star)
        .where(F.col("late_rate") > late_over)
        .select("seller_id", "late_rate")
        .orderBy(F.desc("late_rate"), "seller_id")
    )


def customer_geography(star, rows: int = 15) -> DataFrame:
    """States with most customers and their share of all customers with a known state."""
    per_state = (
        star.customers.where(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(F.count("*").alias("customers"))
    )
    total = star.customers.agg(F.count("customer_state")).scalar()
    return (
        per_state.orderBy(F.desc("customers"), "customer_state")
        .limit(rows)
        .select(
            "customer_state",
            "customers",
            half_up(percent(F.col("customers"), total), 1).alias("pct"),
        )
        .orderBy(F.desc("customers"), "customer_state")
    )


def corr_matrix(star) -> DataFrame:
    """Lower triangle of the Pearson matrix, each pair over the rows where both are present."""
    pairs = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[: i + 1]]
    # One small row per pair, reduced where it is made: far less code than 45 aggregates.
    cells = [
        F.struct(
            F.lit(i).alias("pair"),
            F.col(a).cast("double").alias("x"),
            F.col(b).cast("double").alias("y"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return (
        delivered(star.fact)
        .select(F.inline(F.array(*cells)))
        .groupBy("pair")
        .agg(F.round(F.corr("x", "y"), 6).alias("corr"))
        .withColumn("of", names[F.col("pair")])
        .select(F.col("of.a").alias("col_a"), F.col("of.b").alias("col_b"), "corr")
    )
