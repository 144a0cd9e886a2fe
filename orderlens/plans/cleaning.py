"""Cleaning of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_TIMESTAMPS = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
ISO_SECONDS = "yyyy-MM-dd HH:mm:ss"
UNKNOWN = "unknown"

PRODUCT_COLUMNS = (
    "product_id",
    "product_category",
    "product_category_original",
    "product_weight_g",
    "product_length_cm",
    "product_height_cm",
    "product_width_cm",
    "product_volume_cm3",
    "product_photos_qty",
    "product_name_length",
    "product_description_length",
)


def clean_orders(orders: DataFrame) -> DataFrame:
    """Parse the five timestamps (unparsable text becomes null) and add the purchase date.

    No status filter: undelivered orders stay in the fact table.
    """

    def parsed(name: str):
        if isinstance(orders.schema[name].dataType, T.StringType):
            return F.expr(f"try_cast({name} as timestamp_ntz)")
        return F.col(name).cast("timestamp_ntz")

    typed = orders.withColumns({name: parsed(name) for name in ORDER_TIMESTAMPS})
    return typed.withColumn("order_date_key", F.to_date("order_purchase_timestamp"))


def clean_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """English category, fixed column spelling and volume; missing categories are 'unknown'."""
    sides = [
        F.coalesce(F.col(c), F.lit(0.0))
        for c in ("product_length_cm", "product_height_cm", "product_width_cm")
    ]
    return (
        products.join(translation, "product_category_name", "left")
        .withColumnsRenamed(
            {
                "product_name_lenght": "product_name_length",
                "product_description_lenght": "product_description_length",
            }
        )
        .withColumns(
            {
                "product_category": F.coalesce("product_category_name_english", F.lit(UNKNOWN)),
                "product_category_original": F.coalesce("product_category_name", F.lit(UNKNOWN)),
                "product_volume_cm3": sides[0] * sides[1] * sides[2],
            }
        )
        .select(*PRODUCT_COLUMNS)
    )


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """One review per order, the earliest by creation date (missing dates last), ties by id.

    A minimum is combined before the shuffle, so an order with very many reviews never has to
    be sorted by one task.
    """
    first = F.min(
        F.struct(
            F.col("review_creation_date").isNull().alias("undated"),
            "review_creation_date",
            "review_id",
            "review_score",
            F.length(F.coalesce("review_comment_message", F.lit(""))).alias("comment_length"),
        )
    )
    return reviews.groupBy("order_id").agg(first.alias("first")).select(
        "order_id",
        F.col("first.review_score").alias("review_score"),
        F.col("first.comment_length").alias("review_comment_length"),
    )


def aggregate_payments(payments: DataFrame) -> DataFrame:
    """Per order: total value, most installments, most frequent type (ties alphabetically)."""
    cents = F.rint(F.col("payment_value") * F.lit(100.0)).cast("long")
    return payments.groupBy("order_id").agg(
        (F.coalesce(F.sum(cents), F.lit(0)) / F.lit(100.0)).alias("payment_value"),
        F.max("payment_installments").alias("payment_installments"),
        F.coalesce(F.mode("payment_type", deterministic=True), F.lit(UNKNOWN)).alias(
            "payment_type"
        ),
    )
