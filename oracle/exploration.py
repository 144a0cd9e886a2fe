"""DuckDB statements for the exploratory figures."""

from __future__ import annotations

from oracle.reports import DELAY, SUM_VALUE, YM, _JOIN, case_bucket, pct
from oracle.tables import half_up, money_mean

FACT = (
    "order_id", "order_item_id", "customer_unique_id", "product_id", "seller_id",
    "order_date_key", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date",
    "order_estimated_delivery_date", "price", "freight_value", "total_item_value",
    "payment_type", "payment_installments", "payment_value", "delivery_days",
    "estimated_delivery_days", "delivery_delay_days", "is_late", "is_delivered", "review_score",
    "review_comment_length",
)
CORRELATED = (
    "price", "freight_value", "total_item_value", "delivery_days", "estimated_delivery_days",
    "delivery_delay_days", "review_score", "payment_installments", "review_comment_length",
)
EXTRA = {
    "sellers_m": f"""SELECT f.seller_id, f.revenue, f.orders, f.avg_review, f.late_rate, s.seller_state FROM (
        SELECT seller_id, {SUM_VALUE} AS revenue, count(DISTINCT order_id) AS orders,
               {half_up("avg(review_score)", 6)} AS avg_review, {half_up("avg(is_late)", 6)} AS late_rate
        FROM delivered GROUP BY 1) f LEFT JOIN sell s ON f.seller_id = s.seller_id""",
}


def histogram(source: str, value: str, bins: int) -> str:
    edge = "lo / 100::DOUBLE + ({}) * ((hi - lo) / (100::DOUBLE * " + str(bins) + "))"
    return f"""SELECT * FROM (WITH v AS (SELECT CAST(round_even({value} * 100, 0) AS BIGINT) AS v FROM {source} WHERE {value} IS NOT NULL),
        r AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
        h AS (SELECT least(coalesce((v - lo) * {bins} // nullif(hi - lo, 0), 0), {bins - 1}) AS bin, count(*) AS n
              FROM v, r GROUP BY 1)
        SELECT b.bin, {half_up(edge.format("b.bin"), 6)} AS lower, {half_up(edge.format("b.bin + 1"), 6)} AS upper,
               coalesce(h.n, 0) AS count
        FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN r LEFT JOIN h ON b.bin = h.bin)"""


SQL: dict[str, str] = {}
SQL["overview"] = f"""SELECT count(*) AS total_items, CAST(SUM(is_delivered) AS BIGINT) AS delivered_items,
    count(DISTINCT order_id) AS unique_orders,
    strftime(min(order_purchase_timestamp), '%Y-%m-%d') AS first_date,
    strftime(max(order_purchase_timestamp), '%Y-%m-%d') AS last_date,
    (SELECT {SUM_VALUE} FROM delivered) AS total_gmv,
    (SELECT {half_up(money_mean("total_item_value"), 2)} FROM delivered) AS avg_item_value,
    (SELECT count(*) FROM cust) AS unique_customers, (SELECT count(*) FROM prod) AS unique_products,
    (SELECT count(*) FROM sell) AS unique_sellers FROM fact"""
SQL["null_profile"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, "
    f"{pct(f'(count(*) - count({c}))', 'count(*)', 1)} AS pct FROM fact"
    for c in FACT
) + ") WHERE nulls > 0"
SQL["trend_monthly"] = (
    f"SELECT {YM} AS year_month, count(DISTINCT order_id) AS orders, {SUM_VALUE} AS gmv FROM delivered GROUP BY 1"
)
SQL["eda_category_top15"] = f"""SELECT product_category, {SUM_VALUE} AS revenue
    FROM delivered f JOIN prod p ON f.product_id = p.product_id GROUP BY 1
    ORDER BY revenue DESC, product_category LIMIT 15"""
SQL["eda_state_top15"] = f"""SELECT customer_state, {SUM_VALUE} AS revenue FROM delivered f {_JOIN} GROUP BY 1
    ORDER BY revenue DESC, customer_state LIMIT 15"""
SQL["hist_delivery_days"] = f"""SELECT *, (SELECT {half_up("median(delivery_days)", 6)} FROM dated_items) AS median
    FROM ({histogram("dated_items", "least(greatest(delivery_days, 0), 60)", 40)})"""
SQL["hist_delay_days"] = histogram("dated_items", "least(greatest(delivery_delay_days, -30), 30)", 50)
SQL["ontime_split"] = "SELECT is_late, count(*) AS count FROM dated_items GROUP BY 1"
SQL["review_counts"] = (
    "SELECT review_score, count(*) AS count FROM delivered WHERE review_score IS NOT NULL GROUP BY 1"
)
SQL["review_by_late"] = f"""SELECT d.is_late, review_score, count(*) AS count, any_value(m.mean_review) AS mean_review
    FROM delivered d JOIN (SELECT is_late, {half_up("avg(review_score)", 6)} AS mean_review FROM delivered GROUP BY 1) m
      ON d.is_late = m.is_late WHERE review_score IS NOT NULL GROUP BY 1, 2"""
SQL["review_by_delay_bucket"] = f"""SELECT
    {case_bucket("delivery_delay_days", DELAY, ["'<-7d'", "'-7 to -3d'", "'-3 to 0d'", "'0-3d late'", "'3-7d late'", "'7-14d late'", "'>14d late'"])}
      AS delay_bucket,
    {case_bucket("delivery_delay_days", DELAY, ["1", "2", "3", "4", "5", "6", "7"])} AS bucket_order,
    {half_up("avg(review_score)", 6)} AS avg_review
    FROM delivered WHERE review_score IS NOT NULL AND delivery_delay_days IS NOT NULL GROUP BY 1, 2"""
SQL["eda_payment"] = f"""SELECT payment_type, count(DISTINCT order_id) AS orders, {SUM_VALUE} AS revenue
    FROM delivered WHERE payment_type IS NOT NULL GROUP BY 1"""
SQL["eda_payment_top5"] = """SELECT payment_type, count(DISTINCT order_id) AS orders
    FROM delivered WHERE payment_type IS NOT NULL GROUP BY 1 ORDER BY orders DESC, payment_type LIMIT 5"""
SQL["seller_metrics"] = "SELECT * FROM sellers_m"
SQL["hist_seller_revenue"] = histogram("sellers_m", "revenue", 50)
SQL["hist_seller_orders"] = histogram("sellers_m", "least(greatest(orders, 0), 100)", 40)
SQL["seller_states_top10"] = """SELECT seller_state, count(*) AS sellers FROM sellers_m
    WHERE seller_state IS NOT NULL GROUP BY 1 ORDER BY sellers DESC, seller_state LIMIT 10"""
SQL["seller_scatter"] = f"""SELECT seller_id, {half_up("late_rate * 100", 4)} AS late_pct, avg_review,
    {half_up("log10(revenue + 1)", 6)} AS log10_revenue FROM sellers_m WHERE orders >= 5"""
SQL["seller_quality_gate"] = "SELECT seller_id, late_rate FROM sellers_m WHERE late_rate > 0.15"
SQL["customer_geography"] = f"""SELECT customer_state, count(*) AS customers,
    {pct("count(*)", "(SELECT count(customer_state) FROM cust)", 1)} AS pct
    FROM cust WHERE customer_state IS NOT NULL GROUP BY 1 ORDER BY customers DESC, customer_state LIMIT 15"""
SQL["corr_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {half_up(f'corr({a}, {b})', 6)} AS corr FROM delivered"
    for i, a in enumerate(CORRELATED)
    for b in CORRELATED[: i + 1]
)
