"""DuckDB definitions of the raw, cleaned and star tables, as named common table expressions.

Each entry is (body, names it reads); `with_tables` assembles the clause a query needs.
"""

from __future__ import annotations

import re


def half_up(x: str, digits: int) -> str:
    """Round half away from zero on the shortest decimal form of a double."""
    return f"CAST(ROUND(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def half_even(x: str, digits: int = 2) -> str:
    scale = f"{10**digits}::DOUBLE"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def money_sum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def money_mean(x: str) -> str:
    return f"({money_sum(x)} / NULLIF(COUNT({x}), 0))"


def _days(start: str, end: str) -> str:
    return half_even(f"date_diff('second', {start}, {end}) / 86400::DOUBLE")


TABLES = {
    "dated": """
        SELECT o_orderkey, o_custkey, o_orderdate, c_mktsegment,
               o_orderstatus IN ('F','O') AS sent, pts,
               CASE WHEN o_orderstatus IN ('F','O') AND o_orderkey % 500 <> 0 THEN
                    pts + to_days(CAST(1 + (o_orderkey*31 + o_custkey*17) % 28 + (c_nationkey % 5)*2 AS INTEGER))
                        + to_seconds((o_orderkey*104729) % 86400) END AS delivered_at,
               o_orderdate + to_days(CAST(20 + o_custkey % 20 AS INTEGER)) AS estimated_at
        FROM (SELECT *, o_orderdate + to_seconds((o_orderkey*7919) % 86400) AS pts FROM orders) o
        JOIN customer ON o_custkey = c_custkey""",
    "raw_customers": """
        SELECT o_orderkey AS customer_id, o_custkey AS customer_unique_id,
               c_mktsegment || '-' || (o_orderkey % 3) AS customer_city, n_name AS customer_state
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "raw_items": """
        SELECT l_orderkey AS order_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber,
                    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER)
                 AS order_item_id,
               l_partkey AS product_id, l_suppkey AS seller_id,
               round_even(l_extendedprice*100, 0)/100 AS price, l_quantity*0.5::DOUBLE AS freight_value
        FROM lineitem""",
    "raw_payments": """
        SELECT o_orderkey AS order_id, seq,
               CASE WHEN o_orderkey % 83 <> 0 THEN
                 ['boleto','credit_card','debit_card','voucher'][CAST(1 + (o_orderkey + seq // 2) % 4 AS INTEGER)] END
                 AS payment_type,
               CAST(1 + (o_orderkey*7 + seq) % 10 AS INTEGER) AS payment_installments,
               (CAST(round_even(o_totalprice*100, 0) AS BIGINT) // (1 + o_orderkey % 3)) / 100::DOUBLE AS payment_value
        FROM (SELECT *, unnest(range(1, 2 + o_orderkey % 3)) AS seq FROM orders WHERE o_orderkey % 71 <> 0)""",
    "raw_reviews": """
        SELECT o_orderkey*10 + seq AS review_id, o_orderkey AS order_id,
               CAST(CASE WHEN seq = 0 THEN s0 ELSE 1 + s0 % 5 END AS INTEGER) AS review_score,
               CASE WHEN o_orderkey % 3 <> 0 THEN repeat('x', CAST(o_orderkey % 50 AS INTEGER)) END
                 AS review_comment_message,
               strftime(o_orderdate + to_days(CAST(30 + CASE WHEN o_orderkey % 50 = 0 THEN -seq ELSE seq END AS INTEGER)),
                        '%Y-%m-%d') AS review_creation_date
        FROM (SELECT *, unnest(CASE WHEN o_orderkey % 25 = 0 THEN [0,1] ELSE [0] END) AS seq,
                     CASE WHEN coalesce(delivered_at > estimated_at, false) THEN 1 + (o_orderkey*13) % 4
                          ELSE 3 + (o_orderkey*13) % 3 END AS s0
              FROM dated WHERE o_orderkey % 60 <> 0)""",
    "raw_products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 53 <> 0 THEN p_brand END AS product_category_name,
               CAST(length(p_name) AS INTEGER) AS product_name_lenght,
               CAST(50 + p_partkey % 400 AS INTEGER) AS product_description_lenght,
               CASE WHEN p_partkey % 89 <> 0 THEN CAST(1 + p_partkey % 6 AS INTEGER) END AS product_photos_qty,
               CASE WHEN p_partkey % 97 <> 0 THEN CAST(p_size*250 AS DOUBLE) END AS product_weight_g,
               CAST(10 + p_size AS DOUBLE) AS product_length_cm,
               CAST(5 + p_partkey % 20 AS DOUBLE) AS product_height_cm,
               CASE WHEN p_partkey % 101 <> 0 THEN CAST(8 + p_partkey % 15 AS DOUBLE) END AS product_width_cm
        FROM part""",
    "translation": """
        SELECT DISTINCT p_brand AS product_category_name,
               lower(replace(p_brand, '#', '_')) AS product_category_name_english
        FROM part WHERE p_brand NOT IN ('Brand#3','Brand#7')""",
    "raw_sellers": """
        SELECT s_suppkey AS seller_id, s_name AS seller_city, n_name AS seller_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "orders_c": """
        SELECT o_orderkey AS order_id, o_orderkey AS customer_id,
               CASE WHEN sent THEN 'delivered' ELSE 'shipped' END AS order_status,
               pts AS order_purchase_timestamp, pts + INTERVAL 1 HOUR AS order_approved_at,
               CASE WHEN sent THEN pts + INTERVAL 1 DAY END AS order_delivered_carrier_date,
               delivered_at AS order_delivered_customer_date,
               estimated_at AS order_estimated_delivery_date,
               CAST(pts AS DATE) AS order_date_key
        FROM dated""",
    "products_c": """
        SELECT product_id, coalesce(t.product_category_name_english, 'unknown') AS product_category,
               coalesce(p.product_category_name, 'unknown') AS product_category_original,
               product_weight_g, product_length_cm, product_height_cm, product_width_cm,
               coalesce(product_length_cm, 0)*coalesce(product_height_cm, 0)*coalesce(product_width_cm, 0)
                 AS product_volume_cm3,
               product_photos_qty, product_name_lenght AS product_name_length,
               product_description_lenght AS product_description_length
        FROM raw_products p LEFT JOIN translation t ON p.product_category_name = t.product_category_name""",
    "reviews_c": """
        SELECT order_id, review_score,
               CAST(length(coalesce(review_comment_message, '')) AS INTEGER) AS review_comment_length
        FROM raw_reviews
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY review_creation_date NULLS LAST, review_id) = 1""",
    "payments_c": """
        SELECT p.order_id, coalesce(""" + money_sum("payment_value") + """, 0) AS payment_value,
               max(payment_installments) AS payment_installments,
               coalesce(any_value(m.payment_type), 'unknown') AS payment_type
        FROM raw_payments p LEFT JOIN (
            SELECT order_id, payment_type FROM raw_payments WHERE payment_type IS NOT NULL
            GROUP BY order_id, payment_type
            QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, payment_type) = 1
        ) m ON p.order_id = m.order_id GROUP BY p.order_id""",
    "fact": """
        SELECT *, CASE WHEN delivery_delay_days > 0 THEN 1 ELSE 0 END AS is_late,
               CASE WHEN order_status = 'delivered' THEN 1 ELSE 0 END AS is_delivered
        FROM (
            SELECT i.order_id, i.order_item_id, c.customer_unique_id, i.product_id, i.seller_id,
                   o.order_date_key, o.order_status, o.order_purchase_timestamp, o.order_approved_at,
                   o.order_delivered_carrier_date, o.order_delivered_customer_date,
                   o.order_estimated_delivery_date, i.price, i.freight_value,
                   CAST(CAST(i.price AS DECIMAL(18,2)) + CAST(i.freight_value AS DECIMAL(18,2)) AS DOUBLE)
                     AS total_item_value,
                   p.payment_type, p.payment_installments, p.payment_value,
                   """ + _days("o.order_purchase_timestamp", "o.order_delivered_customer_date") + """ AS delivery_days,
                   """ + _days("o.order_purchase_timestamp", "o.order_estimated_delivery_date") + """
                     AS estimated_delivery_days,
                   """ + _days("o.order_estimated_delivery_date", "o.order_delivered_customer_date") + """
                     AS delivery_delay_days,
                   r.review_score, r.review_comment_length
            FROM raw_items i JOIN orders_c o ON i.order_id = o.order_id
            LEFT JOIN (SELECT DISTINCT customer_id, customer_unique_id FROM raw_customers) c
                   ON o.customer_id = c.customer_id
            LEFT JOIN reviews_c r ON i.order_id = r.order_id
            LEFT JOIN payments_c p ON i.order_id = p.order_id)""",
    "cust": """
        SELECT f.customer_unique_id, f.customer_city, f.customer_state, a.first_order_date, a.total_orders,
               a.total_spent
        FROM (SELECT c.* FROM raw_customers c LEFT JOIN orders_c o ON c.customer_id = o.customer_id
              QUALIFY row_number() OVER (PARTITION BY c.customer_unique_id
                      ORDER BY o.order_purchase_timestamp NULLS LAST, c.customer_id) = 1) f
        LEFT JOIN (SELECT c.customer_unique_id, min(o.order_date_key) AS first_order_date,
                          count(DISTINCT o.order_id) AS total_orders, """ + money_sum("i.price") + """ AS total_spent
                   FROM orders_c o JOIN raw_customers c ON o.customer_id = c.customer_id
                   JOIN raw_items i ON o.order_id = i.order_id GROUP BY 1) a
               ON f.customer_unique_id = a.customer_unique_id""",
    "prod": "SELECT * FROM products_c",
    "sell": """
        SELECT s.seller_id, s.seller_city, s.seller_state, a.total_items_sold, a.total_revenue, r.avg_review_score
        FROM raw_sellers s
        LEFT JOIN (SELECT seller_id, count(order_item_id) AS total_items_sold,
                          """ + money_sum("price") + """ AS total_revenue
                   FROM raw_items i JOIN orders_c o ON i.order_id = o.order_id GROUP BY 1) a
               ON s.seller_id = a.seller_id
        LEFT JOIN (SELECT seller_id, """ + half_even("avg(review_score)") + """ AS avg_review_score
                   FROM raw_items i JOIN reviews_c r ON i.order_id = r.order_id GROUP BY 1) r
               ON s.seller_id = r.seller_id""",
    "cal": """
        SELECT CAST(d AS DATE) AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
               CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week,
               dayname(d) AS day_name, monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter,
               CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend
        FROM (SELECT unnest(range(CAST(min(order_date_key) AS TIMESTAMP),
                                  CAST(max(order_date_key) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d
              FROM orders_c)""",
    "delivered": "SELECT * FROM fact WHERE is_delivered = 1",
    "dated_items": "SELECT * FROM fact WHERE is_delivered = 1 AND delivery_days IS NOT NULL",
}


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `sql` with the definitions it (transitively) reads."""
    known = {**TABLES, **(extra or {})}
    order: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", body):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    visit(sql)
    clauses = ",\n".join(f"{name} AS ({known[name]})" for name in order)
    body = sql.strip()
    return f"WITH {clauses}\n{body}" if clauses else body
