"""DuckDB statements equivalent to the registered queries."""

from __future__ import annotations

# Queries that write files and read them back, and what they must equal.
READ_BACK = {
    "csv_round_trip": "fact_orders", "star_round_trip": "fact_orders", "extract_round_trip": "dash_monthly_kpis",
    "category_breakdown_round_trip": "dash_category", "regional_delivery_round_trip": "dash_regional",
    "seller_leaderboard_round_trip": "dash_sellers", "fact_orders_csv": "fact_orders",
    **{f"{name}_{kind}": name for name in ("dim_customers", "dim_products", "dim_sellers", "dim_date") for kind in ("round_trip", "csv")},
}


def statements() -> dict[str, str]:
    from oracle import exploration, reports, risk_sql, tests_sql
    from oracle.tables import with_tables

    parts = (reports, exploration, tests_sql, risk_sql)
    extra = {k: v for part in parts for k, v in part.EXTRA.items()}
    bodies = {k: v for part in parts for k, v in part.SQL.items()}
    bodies |= {name: bodies[same] for name, same in READ_BACK.items()}
    return {name: with_tables(body, extra) for name, body in bodies.items()}
