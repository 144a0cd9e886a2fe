import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle.derived import session_star
from orderlens.plans.star import FACT_COLUMNS, Star, calendar_between
from orderlens.session import build_session

SMALL = "/root/testdata/sf0.001"

FACT_SCHEMA = (
    "order_id string, order_item_id int, customer_unique_id string, product_id string, "
    "seller_id string, order_date_key date, order_status string, "
    "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
    "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
    "order_estimated_delivery_date timestamp_ntz, price double, freight_value double, "
    "total_item_value double, payment_type string, payment_installments int, "
    "payment_value double, delivery_days double, estimated_delivery_days double, "
    "delivery_delay_days double, is_late int, is_delivered int, review_score int, "
    "review_comment_length int"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "tests",
        spark_sql_shuffle_partitions=4,
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
        spark_driver_memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_star(spark):
    return session_star(spark, SMALL)


@pytest.fixture
def make_star(spark):
    """A star from short fact rows (dicts; missing columns are sensible or null)."""

    def build(items, customers=(), products=(), sellers=()):
        rows = []
        for number, item in enumerate(items):
            row = {
                "order_id": f"o{number}", "order_item_id": 1, "customer_unique_id": "c1",
                "product_id": "p1", "seller_id": "s1", "order_date_key": dt.date(2020, 1, 1),
                "order_status": "delivered", "price": 10.0, "freight_value": 0.0,
                "total_item_value": 10.0, "payment_type": "boleto", "payment_installments": 1,
                "delivery_days": 5.0, "estimated_delivery_days": 10.0,
                "delivery_delay_days": -5.0, "is_late": 0, "is_delivered": 1,
                "review_score": 5, "review_comment_length": 0,
                **item,
            }
            day = row["order_date_key"]
            row.setdefault("order_purchase_timestamp", dt.datetime(day.year, day.month, day.day))
            rows.append(tuple(row.get(c) for c in FACT_COLUMNS))
        return Star(
            fact=spark.createDataFrame(rows, FACT_SCHEMA),
            customers=spark.createDataFrame(
                list(customers) or [("c1", "town", "AA", None, 1, 1.0)],
                "customer_unique_id string, customer_city string, customer_state string, "
                "first_order_date date, total_orders long, total_spent double",
            ),
            products=spark.createDataFrame(
                list(products) or [("p1", "toys", 300.0, 10.0, 1)],
                "product_id string, product_category string, product_weight_g double, "
                "product_volume_cm3 double, product_photos_qty int",
            ),
            sellers=spark.createDataFrame(
                list(sellers) or [("s1", "port", "BB", 1, 1.0, 5.0)],
                "seller_id string, seller_city string, seller_state string, "
                "total_items_sold long, total_revenue double, avg_review_score double",
            ),
            dates=calendar_between(spark, dt.date(2020, 1, 1), dt.date(2020, 12, 31)),
        )

    return build


def rows(df):
    return [tuple(r) for r in df.collect()]
