import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from orderlens.plans import delays, explore, hypothesis, metrics, rfm
from orderlens.plans import extracts as dash
from orderlens.plans.star import _days


def day(month, number=1):
    return dt.date(2020, month, number)


def test_delay_is_judged_after_rounding(spark):
    base = dt.datetime(2020, 1, 1)
    data = [(base, base + dt.timedelta(seconds=s)) for s in (432, 433, 0, -1, 1296)] + [(base, None)]
    df = spark.createDataFrame(data, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(_days("a", "b")).collect()] == [0.0, 0.01, 0.0, -0.0, 0.02, None]


def test_growth_looks_at_the_previous_present_month(make_star):
    star = make_star(
        [
            {"order_date_key": day(1), "total_item_value": 10.0},
            {"order_date_key": day(3), "total_item_value": 15.0},
            {"order_date_key": day(4), "total_item_value": 7.0, "is_delivered": 0},
        ]
    )
    assert [(r["year_month"], r["gmv"], r["mom_growth_pct"]) for r in metrics.gmv_monthly(star).collect()] == [
        ("2020-01", 10.0, None), ("2020-03", 15.0, 50.0)
    ]


def test_item_grain_of_reviews_and_rates(make_star):
    items = [{"order_id": "a", "order_item_id": i, "review_score": 1, "is_late": 1} for i in (1, 2, 3)]
    star = make_star([*items, {"order_id": "b", "review_score": 5}])
    row = dash.monthly_kpis(star).first()
    assert (row["total_orders"], row["avg_review_score"], row["on_time_rate"]) == (2, 2.0, 0.25)


def test_order_value_and_repeat_rate(make_star):
    star = make_star(
        [
            {"order_id": "a", "total_item_value": 1.1},
            {"order_id": "a", "order_item_id": 2, "total_item_value": 2.2},
            {"order_id": "b", "total_item_value": 4.0},
            {"order_id": "c", "customer_unique_id": "c2", "total_item_value": 9.0},
        ]
    )
    assert rows(metrics.aov(star)) == [(3, 5.43, 3.3, 9.0, 0.0)]
    assert rows(metrics.repeat_rate(star)) == [(2, 1, 50.0, 1.5, 2)]


def test_empty_fact_gives_nulls_not_errors(make_star):
    star = make_star([{"is_delivered": 0}])
    assert rows(metrics.gmv_overall(star)) == [(0, None, None, None, None)]
    assert rows(metrics.repeat_rate(star))[0][2] is None
    assert metrics.delivery_performance(star).first()["on_time_rate_pct"] is None
    assert explore.hist_delivery_days(star).count() == 0
    assert rows(delays.delay_by_seller_tier(star)) == []


def test_null_payment_type_is_kept_by_metrics_and_dropped_by_charts(make_star):
    star = make_star([{"payment_type": None}, {"payment_type": "boleto"}])
    assert [r["payment_type"] for r in metrics.payment_breakdown(star).collect()] == [None, "boleto"]
    assert [r["payment_type"] for r in explore.payments(star).collect()] == ["boleto"]


def test_null_state_is_dropped_by_extracts_and_kept_by_metrics(make_star):
    people = [("c1", "x", None, None, 1, 1.0)]
    star = make_star([{}], customers=people)
    assert dash.regional_delivery(star).count() == 0
    assert [r["customer_state"] for r in metrics.delivery_by_state(star).collect()] == [None]


def test_rank_ties_share_a_rank_and_order_by_name(make_star):
    products = [(f"p{i}", name, 1.0, 1.0, 1) for i, name in enumerate("bac")]
    star = make_star(
        [
            {"product_id": "p0", "total_item_value": 5.0},
            {"product_id": "p1", "total_item_value": 5.0},
            {"product_id": "p2", "total_item_value": 1.0},
        ],
        products=products,
    )
    found = [(r["product_category"], r["revenue_rank"]) for r in metrics.category_rank(star).collect()]
    assert found == [("a", 1), ("b", 1), ("c", 3)]
    assert [r["revenue_rank"] for r in metrics.category_rank(star, rows=2).collect()] == [1, 1]


def test_new_and_returning_customers_add_up(make_star):
    star = make_star(
        [
            {"order_date_key": day(1)}, {"order_date_key": day(1, 9)}, {"order_date_key": day(3)},
            {"order_date_key": day(3), "customer_unique_id": "c2"},
        ]
    )
    assert rows(metrics.new_vs_returning(star)) == [
        ("2020-01", 1, 1, 0, 0.0), ("2020-03", 2, 1, 1, 50.0)
    ]


def test_pivots_count_rows_and_ignore_status(make_star):
    items = [{"order_id": "a"}, {"order_id": "a", "order_item_id": 2}, {"is_delivered": 0}]
    star = make_star(items)
    assert dash.pivot_monthly(star).first()["order_count"] == 2
    assert dash.pivot_cards(star).first()["total_orders"] == 2
    assert dash.pivot_category(star).first()["revenue"] == 30.0


def test_top_sellers_flag_includes_ties(make_star):
    items = [{"seller_id": f"s{i}", "total_item_value": float(max(i, 3))} for i in range(6)]
    star = make_star(items)
    flags = {r["seller_id"]: r["is_top10"] for r in dash.pivot_seller(star, top=3).collect()}
    assert flags == {"s0": 1, "s1": 1, "s2": 1, "s3": 1, "s4": 1, "s5": 1}
    flags = {r["seller_id"]: r["is_top10"] for r in dash.pivot_seller(star, top=2).collect()}
    assert sum(flags.values()) == 2


def test_bands_close_at_eighty_and_ninety(spark):
    df = spark.createDataFrame([("a", 0.91), ("b", 0.9), ("c", 0.8), ("d", 0.79)], "year_month string, on_time_rate double")
    assert [r["band"] for r in dash.ontime_band(df).collect()] == ["green", "yellow", "yellow", "red"]


def test_share_of_no_revenue_is_empty(spark):
    df = spark.createDataFrame([("a", 0.0)], "product_category string, revenue double")
    assert dash.category_share(df).first()["revenue_share"] is None


def test_filters_of_the_extracts(make_star):
    products = [("p1", "toys", 1.0, 1.0, 1), ("p2", "art", 1.0, 1.0, 1)]
    star = make_star([{"product_id": "p1"}, {"product_id": "p2"}], products=products)
    assert [r[0] for r in rows(dash.category_breakdown(star, "art"))] == ["art"]
    assert rows(dash.regional_delivery(star, "ZZ")) == []


def test_histogram_closes_the_last_bin_and_lists_empty_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 60.0, 60.0, 30.0, None)], "v double")
    bins = explore.histogram(df, F.col("v"), 4).collect()
    assert [(r["bin"], r["lower"], r["upper"], r["count"]) for r in bins] == [
        (0, 0.0, 15.0, 1), (1, 15.0, 30.0, 0), (2, 30.0, 45.0, 1), (3, 45.0, 60.0, 2)
    ]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r["count"] for r in explore.histogram(df, F.col("v"), 3).collect()] == [2, 0, 0]


def test_ties_of_rounded_rates_follow_the_name(make_star):
    people = [(f"c{s}", "x", s, None, 1, 1.0) for s in "BCA"]
    star = make_star([{"customer_unique_id": f"c{s}"} for s in "BCA"], customers=people)
    assert [r[0] for r in rows(delays.delay_by_state(star, min_orders=1, rows=2))] == ["A", "B"]
    sellers = [("s1", "x", "S", 1, 1.0, 5.0)]
    star = make_star([{"customer_unique_id": f"c{s}"} for s in "BCA"], customers=people, sellers=sellers)
    assert [r[1] for r in rows(delays.delay_corridors(star, min_orders=1, rows=2))] == ["A", "B"]


def test_frequency_ties_are_ordered_by_spend(make_star):
    """Nine of ten people ordered once: their frequency scores follow what they spent."""
    items = [
        {"customer_unique_id": f"c{i}", "total_item_value": 100.0 - i, "order_date_key": day(1, i + 1)}
        for i in range(9)
    ] + [{"customer_unique_id": "c9", "order_id": f"x{i}", "total_item_value": 1.0} for i in range(2)]
    people = [(f"c{i}", "x", "AA", None, 1, 1.0) for i in range(10)]
    star = make_star(items, customers=people)
    scores = {r["customer_unique_id"]: r for r in rfm.scored_customers(star).collect()}
    assert scores["c9"]["f_score"] == 5 and scores["c0"]["f_score"] == 5
    assert scores["c8"]["f_score"] == 1 and scores["c7"]["f_score"] == 1
    assert scores["c8"]["r_score"] == 5 and scores["c8"]["recency_days"] == 0
    assert scores["c0"]["m_score"] == 5 and scores["c9"]["m_score"] == 1
    top = rfm.rfm_scores(star).first()
    assert top["rfm_string"].count("-") == 2


@pytest.mark.parametrize(
    "scores, name",
    [
        ((4, 4, 4), "Champions"), ((1, 4, 3), "Loyal Customers"), ((5, 4, 2), "Potential Loyalists"),
        ((4, 2, 5), "Potential Loyalists"), ((4, 1, 1), "New Customers"), ((2, 3, 5), "At Risk"),
        ((2, 5, 2), "At Risk"), ((2, 2, 4), "Cant Lose Them"), ((1, 1, 3), "Hibernating"),
        ((3, 3, 1), "Need Attention"), ((3, 2, 5), "About to Sleep"), ((4, 5, 2), "Others"),
        ((3, 4, 2), "Others"),
    ],
)
def test_every_segment(spark, scores, name):
    df = spark.createDataFrame([scores], "r_score int, f_score int, m_score int")
    assert rows(df.select(rfm.segment())) == [(name,)]


def test_mann_whitney_sides_add_up(small_star):
    groups = {r["is_late"]: r["n"] for r in hypothesis.late_group_stats(small_star).collect()}
    u = hypothesis.mann_whitney(small_star).first()["u"]
    assert 0 <= u <= groups[0] * groups[1]


def test_anova_on_a_worked_example(make_star):
    """Groups 1,2,3 and 2,3,4 and 5,6,7: F = 13, eta squared = 13/16."""
    items, people = [], []
    for state, values in {"A": (1, 2, 3), "B": (2, 3, 4), "C": (5, 6, 7)}.items():
        people.append((f"c{state}", "x", state, None, 1, 1.0))
        items += [{"customer_unique_id": f"c{state}", "delivery_days": float(v)} for v in values]
    star = make_star(items, customers=people)
    row = hypothesis.anova(star).first()
    assert (row["f"], row["df1"], row["df2"]) == (pytest.approx(13.0), 2, 6)
    assert row["eta_squared"] == pytest.approx(13 / 16) and row["band"] == "large"
    # Ranks 1, 2.5, 4.5 / 2.5, 4.5, 6 / 7, 8, 9 with two ties of two.
    h = 12 / 90 * (8**2 / 3 + 13**2 / 3 + 24**2 / 3) - 30
    assert hypothesis.kruskal(star).first()["h"] == pytest.approx(h / (1 - 12 / 720))


def test_summary_lists_six_tests(small_star):
    found = {r["test"]: r for r in hypothesis.summary(small_star).collect()}
    assert set(found) == {"pearson", "spearman", "welch_t", "mann_whitney", "anova", "kruskal"}
    assert all(0 <= r["p"] <= 1 for r in found.values())
    assert found["welch_t"]["significant"]


def test_invariants(small_star):
    items = delays.delay_distribution(small_star).agg(F.sum("item_count")).first()[0]
    assert items == small_star.fact.where("is_delivered = 1 and delivery_delay_days is not null").count()
    monthly = dash.monthly_kpis(small_star).agg(F.round(F.sum("total_gmv"), 2)).first()[0]
    regional = dash.regional_delivery(small_star).agg(F.round(F.sum("total_revenue"), 2)).first()[0]
    category = dash.category_breakdown(small_star).agg(F.round(F.sum("revenue"), 2)).first()[0]
    assert monthly == regional == category == metrics.gmv_overall(small_star).first()["total_gmv"]
    assert explore.hist_delay_days(small_star).agg(F.sum("count")).first()[0] == items
