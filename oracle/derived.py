"""Raw order tables derived from the TPC-H-like Parquet tables used for checks.

A deterministic mapping by integer arithmetic and dates only, so that another engine can
repeat it exactly.  Ids keep their integer type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators.skew import number_within
from orderlens.session import SessionStar
from orderlens.sources.raw_csv import RawTables

PAYMENT_TYPES = ("boleto", "credit_card", "debit_card", "voucher")
UNTRANSLATED_BRANDS = ("Brand#3", "Brand#7")


def _shift(seconds: str, days: str = "0") -> str:
    return f"make_dt_interval(cast({days} as int), 0, 0, cast({seconds} as int))"


def _order_dates(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Order-level columns shared by the raw orders and reviews."""
    pts = f"o_orderdate + {_shift('(o_orderkey * 7919) % 86400')}"
    arrival_days = "1 + (o_orderkey * 31 + o_custkey * 17) % 28 + (c_nationkey % 5) * 2"
    dated = (
        orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        .join(
            customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"),
            "o_custkey",
        )
        .withColumn("pts", F.expr(pts))
        .withColumn("sent", F.col("o_orderstatus").isin("F", "O"))
    )
    return dated.withColumns(
        {
            "delivered_at": F.when(
                F.col("sent") & F.expr("o_orderkey % 500 <> 0"),
                F.expr(f"pts + {_shift('(o_orderkey * 104729) % 86400', arrival_days)}"),
            ),
            "estimated_at": F.expr(f"o_orderdate + {_shift('0', '20 + o_custkey % 20')}"),
        }
    )


def derive_raw(spark: SparkSession, directory: str) -> RawTables:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    nation = table("nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    customer = table("customer")
    dated = _order_dates(table("orders"), customer)

    orders = dated.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("customer_id"),
        F.when(F.col("sent"), "delivered").otherwise("shipped").alias("order_status"),
        F.col("pts").alias("order_purchase_timestamp"),
        F.expr("pts + interval 1 hour").alias("order_approved_at"),
        F.when(F.col("sent"), F.expr("pts + interval 1 day")).alias("order_delivered_carrier_date"),
        F.col("delivered_at").alias("order_delivered_customer_date"),
        F.col("estimated_at").alias("order_estimated_delivery_date"),
    )

    customers = (
        table("orders")
        .select("o_orderkey", "o_custkey")
        .join(customer.select("c_custkey", "c_mktsegment", "c_nationkey"),
              F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("nationkey"))
        .select(
            F.col("o_orderkey").alias("customer_id"),
            F.col("o_custkey").alias("customer_unique_id"),
            F.expr("concat(c_mktsegment, '-', o_orderkey % 3)").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )

    lines = number_within(
        table("lineitem"),
        "l_orderkey",
        "l_partkey",
        [
            "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate",
        ],
        "order_item_id",
    )
    order_items = lines.select(
        F.col("l_orderkey").alias("order_id"),
        "order_item_id",
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        (F.rint(F.col("l_extendedprice") * 100) / 100).alias("price"),
        (F.col("l_quantity") * 0.5).alias("freight_value"),
    )

    types = ", ".join(f"'{t}'" for t in PAYMENT_TYPES)
    payments = (
        table("orders")
        .where("o_orderkey % 71 <> 0")
        .select(
            "o_orderkey",
            F.expr("cast(rint(o_totalprice * 100) as bigint)").alias("cents"),
            F.expr("1 + o_orderkey % 3").alias("parts"),
        )
        .withColumn("seq", F.explode(F.expr("sequence(1L, parts)")))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.when(
                F.expr("o_orderkey % 83 <> 0"),
                F.expr(
                    f"element_at(array({types}), cast(1 + (o_orderkey + seq div 2) % 4 as int))"
                ),
            ).alias("payment_type"),
            F.expr("cast(1 + (o_orderkey * 7 + seq) % 10 as int)").alias("payment_installments"),
            (F.expr("cents div parts") / F.lit(100.0)).alias("payment_value"),
        )
    )

    late = F.coalesce(F.col("delivered_at") > F.col("estimated_at"), F.lit(False))
    first_score = F.when(late, F.expr("1 + (o_orderkey * 13) % 4")).otherwise(
        F.expr("3 + (o_orderkey * 13) % 3")
    )
    reviews = (
        dated.where("o_orderkey % 60 <> 0")
        .withColumn("first_score", first_score)
        .withColumn("seq", F.explode(F.expr("sequence(0, if(o_orderkey % 25 = 0, 1, 0))")))
        .select(
            F.expr("o_orderkey * 10 + seq").alias("review_id"),
            F.col("o_orderkey").alias("order_id"),
            F.expr("cast(if(seq = 0, first_score, 1 + first_score % 5) as int)").alias(
                "review_score"
            ),
            F.expr(
                "if(o_orderkey % 3 = 0, null, repeat('x', cast(o_orderkey % 50 as int)))"
            ).alias("review_comment_message"),
            F.expr(
                "date_format(date_add(cast(o_orderdate as date),"
                " 30 + if(o_orderkey % 50 = 0, -seq, seq)), 'yyyy-MM-dd')"
            ).alias("review_creation_date"),
        )
    )

    part = table("part")
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.expr("if(p_partkey % 53 = 0, null, p_brand)").alias("product_category_name"),
        F.expr("length(p_name)").alias("product_name_lenght"),
        F.expr("cast(50 + p_partkey % 400 as int)").alias("product_description_lenght"),
        F.expr("if(p_partkey % 89 = 0, null, cast(1 + p_partkey % 6 as int))").alias(
            "product_photos_qty"
        ),
        F.expr("if(p_partkey % 97 = 0, null, cast(p_size * 250 as double))").alias(
            "product_weight_g"
        ),
        F.expr("cast(10 + p_size as double)").alias("product_length_cm"),
        F.expr("cast(5 + p_partkey % 20 as double)").alias("product_height_cm"),
        F.expr("if(p_partkey % 101 = 0, null, cast(8 + p_partkey % 15 as double))").alias(
            "product_width_cm"
        ),
    )

    translation = (
        part.select("p_brand")
        .distinct()
        .where(~F.col("p_brand").isin(*UNTRANSLATED_BRANDS))
        .select(
            F.col("p_brand").alias("product_category_name"),
            F.expr("lower(replace(p_brand, '#', '_'))").alias("product_category_name_english"),
        )
    )

    sellers = (
        table("supplier")
        .join(nation, F.col("s_nationkey") == F.col("nationkey"))
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )
    )

    return RawTables(
        customers=customers,
        orders=orders,
        order_items=order_items,
        payments=payments,
        reviews=reviews,
        products=products,
        sellers=sellers,
        category_translation=translation,
    )


_stars: dict[tuple[str, str], SessionStar] = {}


def session_star(spark: SparkSession, directory: str) -> SessionStar:
    """The star over the raw tables derived from a data directory, one for each session."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _stars:
        _stars[key] = SessionStar(derive_raw(spark, directory))
    return _stars[key]
