"""Star schema at order-item grain: one fact, four dimensions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.exact import exact_sum, half_even, hundredths
from orderlens.operators.skew import hot_keys, split_join
from orderlens.plans.cleaning import (
    ISO_SECONDS,
    ORDER_TIMESTAMPS,
    PRODUCT_COLUMNS,
    aggregate_payments,
    clean_orders,
    clean_products,
    clean_reviews,
)
from orderlens.sources.raw_csv import RawTables

# Column order of the fact table and the calendar used when no order is dated.
FACT_COLUMNS = (
    "order_id", "order_item_id", "customer_unique_id", "product_id", "seller_id",
    "order_date_key", "order_status",
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
    "price", "freight_value", "total_item_value",
    "payment_type", "payment_installments", "payment_value",
    "delivery_days", "estimated_delivery_days", "delivery_delay_days",
    "is_late", "is_delivered", "review_score", "review_comment_length",
)
FALLBACK_CALENDAR = (dt.date(2016, 1, 1), dt.date(2018, 12, 31))


@dataclass(frozen=True)
class Star:
    fact: DataFrame
    customers: DataFrame
    products: DataFrame
    sellers: DataFrame
    dates: DataFrame
    derived: dict[str, object] = field(default_factory=dict, compare=False, repr=False)

    def once(self, name: str, build: Callable[[], object]):
        """Remember a written intermediate table (or a fitted model) under `name`."""
        if name not in self.derived:
            self.derived[name] = build()
        return self.derived[name]

    def tables(self) -> dict[str, DataFrame]:
        return {
            "fact_orders": self.fact,
            "dim_customers": self.customers,
            "dim_products": self.products,
            "dim_sellers": self.sellers,
            "dim_date": self.dates,
        }


@dataclass(frozen=True)
class Cleaned:
    orders: DataFrame
    products: DataFrame
    reviews: DataFrame
    payments: DataFrame


def clean(raw: RawTables) -> Cleaned:
    return Cleaned(
        orders=clean_orders(raw.orders),
        products=clean_products(raw.products, raw.category_translation),
        reviews=clean_reviews(raw.reviews),
        payments=aggregate_payments(raw.payments),
    )


def _days(start: str, end: str) -> Column:
    """Days between two timestamps, two decimals, half to even."""
    return half_even(F.expr(f"timestampdiff(SECOND, {start}, {end})") / F.lit(86400.0))


def build_fact(raw: RawTables, cleaned: Cleaned) -> DataFrame:
    """Items joined to their order, customer, review and payment.

    Everything known per order is joined first, where keys are unique; the items then meet it
    in one join on the order id, the only one whose key repeats.
    """
    people = raw.customers.select("customer_id", "customer_unique_id").distinct()
    order_level = (
        cleaned.orders.join(people, "customer_id", "left")
        .join(cleaned.reviews, "order_id", "left")
        .join(cleaned.payments, "order_id", "left")
        .withColumns(
            {
                "delivery_days": _days("order_purchase_timestamp", "order_delivered_customer_date"),
                "estimated_delivery_days": _days(
                    "order_purchase_timestamp", "order_estimated_delivery_date"
                ),
                "delivery_delay_days": _days(
                    "order_estimated_delivery_date", "order_delivered_customer_date"
                ),
            }
        )
        .withColumns(
            {
                # Lateness is judged on the rounded delay; an unknown delay is not late.
                "is_late": F.coalesce((F.col("delivery_delay_days") > 0).cast("int"), F.lit(0)),
                "is_delivered": F.coalesce(
                    (F.col("order_status") == "delivered").cast("int"), F.lit(0)
                ),
            }
        )
    )
    value = (hundredths("price") + hundredths("freight_value")) / F.lit(100.0)
    items = raw.order_items.withColumn("total_item_value", value)
    return split_join(items, order_level, "order_id").select(*FACT_COLUMNS)


def build_dim_customers(raw: RawTables, cleaned: Cleaned) -> DataFrame:
    """One row per person: address of the earliest order, and totals over ordered items.

    Item prices are summed per order before they meet the orders, so one aggregation by
    person yields the address and all totals.
    """
    spend = raw.order_items.groupBy("order_id").agg(F.sum(hundredths("price")).alias("cents"))
    ordered = cleaned.orders.select(
        "customer_id", "order_id", "order_purchase_timestamp", "order_date_key"
    )
    visits = raw.customers.join(ordered, "customer_id", "left").join(
        spend.withColumn("has_items", F.lit(True)), "order_id", "left"
    )
    first = F.min(
        F.struct(
            F.col("order_purchase_timestamp").isNull().alias("undated"),
            "order_purchase_timestamp",
            "customer_id",
            "customer_city",
            "customer_state",
        )
    )
    orders = F.countDistinct(F.when(F.col("has_items"), F.col("order_id")))
    return (
        visits.groupBy("customer_unique_id")
        .agg(
            first.alias("first"),
            F.min(F.when(F.col("has_items"), F.col("order_date_key"))).alias("first_order_date"),
            orders.alias("orders"),
            F.sum("cents").alias("cents"),
        )
        .select(
            "customer_unique_id",
            F.col("first.customer_city").alias("customer_city"),
            F.col("first.customer_state").alias("customer_state"),
            "first_order_date",
            F.when(F.col("orders") > 0, F.col("orders")).alias("total_orders"),
            (F.col("cents") / F.lit(100.0)).alias("total_spent"),
        )
    )


def _one_row_per(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """First row per key under the order of its columns; combined before the shuffle."""
    rest = [c for c in columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(
        *[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in columns]
    )


def build_dim_products(cleaned: Cleaned) -> DataFrame:
    return _one_row_per(cleaned.products, "product_id", PRODUCT_COLUMNS)


def build_dim_sellers(raw: RawTables, cleaned: Cleaned) -> DataFrame:
    """One row per seller with items sold, revenue (price only, any status), mean item review."""
    items = raw.order_items.select("order_id", "order_item_id", "seller_id", "price")
    hot = hot_keys(items, "order_id")
    sold = (
        split_join(items, cleaned.orders.select("order_id"), "order_id", hot=hot)
        .groupBy("seller_id")
        .agg(
            F.count("order_item_id").alias("total_items_sold"),
            exact_sum("price").alias("total_revenue"),
        )
    )
    scored = (
        split_join(
            items.select("order_id", "seller_id"),
            cleaned.reviews.select("order_id", "review_score"),
            "order_id",
            hot=hot,
        )
        .groupBy("seller_id")
        .agg(half_even(F.avg("review_score")).alias("avg_review_score"))
    )
    sellers = _one_row_per(raw.sellers, "seller_id", ("seller_id", "seller_city", "seller_state"))
    return sellers.join(sold, "seller_id", "left").join(scored, "seller_id", "left")


def calendar(bounds: DataFrame) -> DataFrame:
    """One row per day between the columns `first_day` and `last_day` of a one-row frame."""
    day = F.col("date_key")
    return (
        bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("date_key"))
        .select(
            "date_key",
            F.year(day).alias("year"),
            F.month(day).alias("month"),
            F.dayofmonth(day).alias("day"),
            F.weekday(day).alias("day_of_week"),
            F.date_format(day, "EEEE").alias("day_name"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.quarter(day).alias("quarter"),
            (F.weekday(day) >= 5).cast("int").alias("is_weekend"),
        )
    )


def calendar_between(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    return calendar(
        spark.range(1).select(F.lit(first).alias("first_day"), F.lit(last).alias("last_day"))
    )


def build_dim_date(cleaned: Cleaned) -> DataFrame:
    first, last = (F.lit(day) for day in FALLBACK_CALENDAR)
    bounds = cleaned.orders.agg(
        F.coalesce(F.min("order_date_key"), first).alias("first_day"),
        F.coalesce(F.max("order_date_key"), last).alias("last_day"),
    )
    return calendar(bounds)


def build_star(raw: RawTables) -> Star:
    cleaned = clean(raw)
    return Star(
        fact=build_fact(raw, cleaned),
        customers=build_dim_customers(raw, cleaned),
        products=build_dim_products(cleaned),
        sellers=build_dim_sellers(raw, cleaned),
        dates=build_dim_date(cleaned),
    )


def iso_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, for exports."""
    formats = {name: ISO_SECONDS for name in ORDER_TIMESTAMPS}
    formats |= {name: "yyyy-MM-dd" for name in ("order_date_key", "date_key", "first_order_date")}
    return df.withColumns(
        {name: F.date_format(name, f) for name, f in formats.items() if name in df.columns}
    )


def check_keys(star: Star) -> DataFrame:
    """Duplicate keys per table, fact rows whose foreign key has no dimension row, and orders with
    more than one payment type (reports by type add up orders)."""
    unique = {
        "fact_orders_unique": (star.fact, ["order_id", "order_item_id"]),
        "dim_customers_unique": (star.customers, ["customer_unique_id"]),
        "dim_products_unique": (star.products, ["product_id"]),
        "dim_sellers_unique": (star.sellers, ["seller_id"]),
        "dim_date_unique": (star.dates, ["date_key"]),
    }
    foreign = {
        "fact_customer_known": ("customer_unique_id", star.customers, "customer_unique_id"),
        "fact_product_known": ("product_id", star.products, "product_id"),
        "fact_seller_known": ("seller_id", star.sellers, "seller_id"),
        "fact_date_known": ("order_date_key", star.dates, "date_key"),
    }
    checks = []
    for name, (df, keys) in unique.items():
        repeated = df.groupBy(*keys).count().where("count > 1")
        checks.append(
            repeated.agg(F.count("*").alias("violations")).select(
                F.lit(name).alias("check_name"), "violations"
            )
        )
    for name, (column, dim, key) in foreign.items():
        # Counting per key first keeps a frequent key to one row in the join.
        used = star.fact.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).count()
        orphans = used.join(dim.select(key), key, "left_anti")
        checks.append(
            orphans.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations")).select(
                F.lit(name).alias("check_name"), "violations"
            )
        )
    types = star.fact.groupBy("order_id").agg(F.min("payment_type").alias("a"), F.max("payment_type").alias("b"))
    checks.append(
        types.where("a <> b").agg(F.count("*").alias("violations")).select(
            F.lit("order_one_payment_type").alias("check_name"), "violations"
        )
    )
    return reduce(DataFrame.unionByName, checks)
