"""Recency, frequency, monetary scoring and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.exact import exact_mean, exact_sum, half_up, percent
from orderlens.operators.order_stats import with_tiles
from orderlens.plans.common import delivered, orders, whole

# Ascending keys of each score; the last one makes the order total.  Frequency ties are
# broken by spend, which decides the segments where most people ordered once.
SCORES = {
    "r_score": (5, ["freshness", "customer_unique_id"]),
    "f_score": (5, ["frequency", "monetary", "customer_unique_id"]),
    "m_score": (5, ["monetary", "customer_unique_id"]),
}

# Segments in order of precedence with their recency, frequency and monetary
# score ranges.
SEGMENTS = (
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal Customers", (1, 5), (4, 5), (3, 5)),
    ("Potential Loyalists", (4, 5), (2, 4), (1, 5)),
    ("New Customers", (4, 5), (1, 2), (1, 5)),
    ("At Risk", (1, 2), (3, 5), (1, 5)),
    ("Cant Lose Them", (1, 2), (1, 5), (4, 5)),
    ("Hibernating", (1, 2), (1, 2), (1, 5)),
    ("Need Attention", (3, 3), (3, 3), (1, 5)),
    ("About to Sleep", (1, 3), (1, 3), (1, 5)),
)
NO_SEGMENT = "Others"


def _spend(star) -> DataFrame:
    latest = delivered(star.fact).agg(F.max("order_date_key")).scalar()
    return (
        delivered(star.fact)
        .groupBy("customer_unique_id")
        .agg(
            F.max("order_date_key").alias("last_order"),
            orders().alias("frequency"),
            exact_sum("total_item_value").alias("monetary"),
        )
        .select(
            "customer_unique_id",
            F.datediff(latest, "last_order").alias("recency_days"),
            "frequency",
            "monetary",
        )
    )


def rfm_raw(star) -> DataFrame:
    """Per known customer; orders are aggregated by person before the address is joined."""
    people = star.customers.select("customer_unique_id", "customer_city", "customer_state")
    return _spend(star).join(people, "customer_unique_id").select(
        "customer_unique_id", "customer_city", "customer_state",
        "recency_days", "frequency", "monetary",
    )


def scored(raw: DataFrame, name: str) -> DataFrame:
    """Add r, f and m scores from 1 to 5 (5 is recent, frequent, high)."""
    ordered = raw.withColumn("freshness", -F.col("recency_days"))
    return with_tiles(ordered, SCORES, name).drop("freshness")


def segment() -> Column:
    """Name of the first segment whose score ranges all hold."""
    named = None
    for name, *ranges in SEGMENTS:
        test = F.lit(True)
        for score, (low, high) in zip(SCORES, ranges):
            test = test & F.col(score).between(low, high)
        named = F.when(test, name) if named is None else named.when(test, name)
    return named.otherwise(NO_SEGMENT)


def scored_customers(star) -> DataFrame:
    return star.once("rfm_known", lambda: scored(rfm_raw(star), "rfm_known"))


def rfm_scores(star, rows: int = 30) -> DataFrame:
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    order = [F.desc("rfm_avg"), F.desc("monetary"), "customer_unique_id"]
    return (
        scored_customers(star)
        .select(
            "customer_unique_id", "customer_state", "recency_days", "frequency", "monetary",
            "r_score", "f_score", "m_score",
            half_up(total / F.lit(3.0), 1).alias("rfm_avg"),
            F.concat_ws("-", "r_score", "f_score", "m_score").alias("rfm_string"),
        )
        .orderBy(*order)
        .limit(rows)
    )


def rfm_segments(star) -> DataFrame:
    """Segment sizes over every delivered customer, known address or not."""
    everyone = star.once("rfm_everyone", lambda: scored(_spend(star), "rfm_everyone"))
    grouped = everyone.groupBy(segment().alias("segment")).agg(
        F.count("*").alias("customer_count"),
        half_up(F.avg("recency_days"), 0).alias("avg_recency_days"),
        half_up(F.avg("frequency"), 2).alias("avg_frequency"),
        half_up(exact_mean("monetary"), 2).alias("avg_monetary"),
        exact_sum("monetary").alias("total_revenue"),
    )
    people = percent(F.col("customer_count"), F.sum("customer_count").over(whole()))
    revenue = percent(
        F.col("total_revenue"),
        F.sum(F.rint(F.col("total_revenue") * F.lit(100.0)).cast("long")).over(whole())
        / F.lit(100.0),
    )
    return (
        grouped.withColumns(
            {"pct_of_total": half_up(people, 1), "pct_of_revenue": half_up(revenue, 1)}
        )
        .select(
            "segment", "customer_count", "pct_of_total", "avg_recency_days", "avg_frequency",
            "avg_monetary", "total_revenue", "pct_of_revenue",
        )
        .orderBy(F.desc("total_revenue"), "segment")
    )


def rfm_by_state(star, states: int = 5) -> DataFrame:
    """Segments inside the states with most customers, scored within that population."""

    def build() -> DataFrame:
        top = (
            star.customers.groupBy("customer_state")
            .agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "customer_state")
            .limit(states)
        )
        return scored(rfm_raw(star).join(top, "customer_state", "left_semi"), "rfm_states")

    return (
        star.once(f"rfm_states_{states}", build)
        .groupBy("customer_state", segment().alias("segment"))
        .agg(
            F.count("*").alias("customers"),
            half_up(exact_mean("monetary"), 2).alias("avg_monetary"),
        )
        .orderBy("customer_state", F.desc("customers"), "segment")
    )
