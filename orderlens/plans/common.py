"""Filters, joins and measures shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.functions.exact import exact_mean, half_up

def whole():
    """A window over all rows, used only on report-sized results (one row per group)."""
    return W.partitionBy()


def delivered(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("is_delivered") == 1)


def delivered_dated(fact: DataFrame) -> DataFrame:
    return fact.where((F.col("is_delivered") == 1) & F.col("delivery_days").isNotNull())


def month_start() -> Column:
    """Purchase month as its first day: far cheaper per row than formatting text."""
    return F.trunc("order_date_key", "month")


def year_month(month: str = "month_start") -> Column:
    return F.date_format(month, "yyyy-MM").alias("year_month")


def per_month(items: DataFrame, *measures: Column) -> DataFrame:
    """Measures per purchase month; the month is formatted once per group."""
    grouped = items.groupBy(month_start().alias("month_start")).agg(*measures)
    return grouped.select(year_month(), *[c for c in grouped.columns if c != "month_start"])


def with_state(fact: DataFrame, customers: DataFrame, how: str = "inner") -> DataFrame:
    return fact.join(customers.select("customer_unique_id", "customer_state"),
                     "customer_unique_id", how)


def with_category(fact: DataFrame, products: DataFrame, how: str = "inner") -> DataFrame:
    return fact.join(products.select("product_id", "product_category"), "product_id", how)


def orders() -> Column:
    return F.countDistinct("order_id")


def late_pct() -> Column:
    return half_up(F.avg("is_late") * F.lit(100.0), 1)


def mean_days(name: str, digits: int = 1) -> Column:
    return half_up(exact_mean(name), digits)


def mean_review(digits: int = 2) -> Column:
    return half_up(F.avg("review_score"), digits)


def mean_late_delay() -> Column:
    return half_up(
        exact_mean(F.when(F.col("is_late") == 1, F.col("delivery_delay_days"))), 1
    )
