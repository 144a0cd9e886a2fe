"""Named queries over the derived tables of one data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.plans import cleaning, delays, explore, hypothesis, metrics, rfm, risk, round_trips, star as plans
from orderlens.plans import extracts as dash
from orderlens.plans import risk_model as models
from orderlens.session import SessionStar
from orderlens.sources.raw_csv import load_profile



def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating-point columns rounded for reporting."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


Query = Callable[[SparkSession, str], DataFrame]

# Table builders, computed from the raw tables of the session's star.
FROM_RAW: dict[str, Callable[[SessionStar], DataFrame]] = {
    "load_profile": lambda s: load_profile(s.raw),
    "clean_orders": lambda s: plans.iso_text(cleaning.clean_orders(s.raw.orders)),
    "clean_products": lambda s: s.cleaned.products,
    "dedup_reviews": lambda s: s.cleaned.reviews,
    "agg_payments": lambda s: s.cleaned.payments,
    "fact_orders": lambda s: plans.iso_text(plans.build_fact(s.raw, s.cleaned)),
    "dim_customers": lambda s: plans.iso_text(plans.build_dim_customers(s.raw, s.cleaned)),
    "dim_products": lambda s: plans.build_dim_products(s.cleaned),
    "dim_sellers": lambda s: plans.build_dim_sellers(s.raw, s.cleaned),
    "dim_date": lambda s: plans.iso_text(plans.build_dim_date(s.cleaned)),
    "csv_round_trip": lambda s: round_trips.raw_csv(s.raw, s.fact),
    "star_round_trip": round_trips.stored_fact,
    **{
        f"{name}_round_trip": lambda s, name=name: round_trips.stored_dimension(s, name)
        for name in ("dim_customers", "dim_products", "dim_sellers", "dim_date")
    },
    **{
        f"{name}_csv": lambda s, name=name: round_trips.star_csv(s, name)
        for name in ("fact_orders", "dim_customers", "dim_products", "dim_sellers", "dim_date")
    },
    "extract_round_trip": lambda s: round_trips.exported_extract(s, "monthly_kpis"),
    **{
        f"{name}_round_trip": lambda s, name=name: round_trips.exported_extract(s, name)
        for name in ("category_breakdown", "regional_delivery", "seller_leaderboard")
    },
}

# Reports over the (written) tables of any star.
REPORTS: dict[str, Callable[..., DataFrame]] = {
    "gmv_monthly": metrics.gmv_monthly,
    "dq_fact_keys": plans.check_keys,
    "dash_monthly_kpis": dash.monthly_kpis,
    "dash_category": dash.category_breakdown,
    "dash_regional": dash.regional_delivery,
    "dash_sellers": dash.seller_leaderboard,
    "kpi_cards": lambda s: dash.kpi_cards(dash.monthly_kpis(s)),
    "top10_categories": lambda s: dash.top_categories(dash.category_breakdown(s)),
    "top10_states": lambda s: dash.top_states(dash.regional_delivery(s)),
    "top10_sellers": lambda s: dash.top_sellers(dash.seller_leaderboard(s)),
    "category_share": lambda s: dash.category_share(dash.category_breakdown(s)),
    "ontime_band": lambda s: dash.ontime_band(dash.monthly_kpis(s)),
    "leaderboard_by_state": lambda s: dash.leaderboard_by_state(dash.seller_leaderboard(s)),
    "pivot_monthly": dash.pivot_monthly,
    "pivot_category": dash.pivot_category,
    "pivot_state": dash.pivot_state,
    "pivot_seller": dash.pivot_seller,
    "pivot_cards": dash.pivot_cards,
    "conditional_aggs": dash.conditional_aggs,
    "high_risk_flags": dash.high_risk_flags,
    "delivery_percentiles": dash.delivery_percentiles,
    "gmv_overall": metrics.gmv_overall,
    "aov": metrics.aov,
    "repeat_rate": metrics.repeat_rate,
    "category_rank": metrics.category_rank,
    "delivery_performance": metrics.delivery_performance,
    "delivery_by_state": metrics.delivery_by_state,
    "seller_rank": metrics.seller_rank,
    "payment_breakdown": metrics.payment_breakdown,
    "new_vs_returning": metrics.new_vs_returning,
    "rfm_raw": rfm.rfm_raw,
    "rfm_scores": rfm.rfm_scores,
    "rfm_segments": rfm.rfm_segments,
    "rfm_by_state": rfm.rfm_by_state,
    "delay_distribution": delays.delay_distribution,
    "delay_by_state": delays.delay_by_state,
    "delay_by_category": delays.delay_by_category,
    "delay_by_seller_tier": delays.delay_by_seller_tier,
    "delay_seasonality": delays.delay_seasonality,
    "delay_by_weekday": delays.delay_by_weekday,
    "delay_corridors": delays.delay_corridors,
    "delay_by_weight": delays.delay_by_weight,
    "overview": explore.overview,
    "null_profile": explore.null_profile,
    "trend_monthly": explore.trend_monthly,
    "eda_category_top15": explore.category_top,
    "eda_state_top15": explore.state_top,
    "hist_delivery_days": explore.hist_delivery_days,
    "hist_delay_days": explore.hist_delay_days,
    "ontime_split": explore.ontime_split,
    "review_counts": explore.review_counts,
    "review_by_late": explore.review_by_late,
    "review_by_delay_bucket": explore.review_by_delay_bucket,
    "eda_payment": explore.payments,
    "eda_payment_top5": explore.payments_top,
    "seller_metrics": explore.seller_metrics,
    "hist_seller_revenue": explore.hist_seller_revenue,
    "hist_seller_orders": explore.hist_seller_orders,
    "seller_states_top10": explore.seller_states_top,
    "seller_scatter": explore.seller_scatter,
    "seller_quality_gate": explore.seller_quality_gate,
    "customer_geography": explore.customer_geography,
    "corr_matrix": explore.corr_matrix,
    "pearson_delay_review": lambda s: rounded(hypothesis.pearson(s)),
    "spearman_delay_review": lambda s: rounded(hypothesis.spearman(s)),
    "regression_line": lambda s: rounded(hypothesis.regression_line(s)),
    "scatter_sample": hypothesis.scatter_sample,
    "box_by_delay": lambda s: rounded(hypothesis.box_by_delay(s)),
    "box_by_state": lambda s: rounded(hypothesis.box_by_state(s)),
    "late_group_stats": lambda s: rounded(hypothesis.late_group_stats(s)),
    "welch_t": lambda s: rounded(hypothesis.welch_t(s)),
    "cohens_d": lambda s: rounded(hypothesis.cohens_d(s)),
    "mean_diff_ci": lambda s: rounded(hypothesis.mean_diff_ci(s)),
    "mann_whitney": lambda s: rounded(hypothesis.mann_whitney(s)),
    "anova_groups": lambda s: rounded(hypothesis.anova_groups(s)),
    "anova_state": lambda s: rounded(hypothesis.anova(s)).withColumn("f", F.round("f", 4)),
    "kruskal_state": lambda s: rounded(hypothesis.kruskal(s)).withColumn("h", F.round("h", 4)),
    "state_mean_ci": lambda s: rounded(hypothesis.state_mean_ci(s)),
    "hypothesis_summary": lambda s: rounded(hypothesis.summary(s)).withColumn("statistic", F.round("statistic", 4)),
    "ml_rows": lambda s: risk.ml_rows(s).select("*"),
    "ml_features": lambda s: rounded(risk.ml_features(s)),
    "ml_imputed": lambda s: rounded(risk.imputed_numbers(s)),
    "ml_design": risk.design_arrays,
    "ml_split": lambda s: risk.ml_split(s).select("order_id", "order_item_id", "is_late", "split"),
    "ml_folds": lambda s: risk.ml_folds(s).select("order_id", "order_item_id", "is_late", "fold"),
    "ml_features_oof": lambda s: rounded(
        risk.ml_features_oof(s).select(
            "order_id", "order_item_id", "is_late", "fold", "seller_late_rate", "state_late_rate"
        )
    ),
    "confusion": lambda s: models.confusion(risk.rule_scores(s)),
    "classification_metrics": lambda s: rounded(
        models.classification_metrics(risk.rule_scores(s))
    ),
    "class_report": lambda s: rounded(models.class_report(risk.rule_scores(s))),
    "roc_points": lambda s: rounded(models.roc_points(risk.rule_scores(s))),
    "risk_tier": risk.rule_tiers,
    "risk_drivers": risk.driver_rows,
    "lr_metrics": lambda s: risk.metrics(s, models.LR),
    "lr_coefficients": risk.logistic_coefficients,
    "lr_confusion": lambda s: models.confusion(risk.scores(s, models.LR)),
    "lr_class_report": lambda s: rounded(models.class_report(risk.scores(s, models.LR))),
    "lr_roc_points": lambda s: rounded(models.roc_points(risk.scores(s, models.LR))),
    "rf_confusion": lambda s: models.confusion(risk.scores(s, models.RF)),
    "rf_class_report": lambda s: rounded(models.class_report(risk.scores(s, models.RF))),
    "rf_roc_points": lambda s: rounded(models.roc_points(risk.scores(s, models.RF))),
    "rf_metrics": lambda s: risk.metrics(s, models.RF),
    "lr_metrics_oof": lambda s: risk.metrics_oof(s, models.LR),
    "rf_metrics_oof": lambda s: risk.metrics_oof(s, models.RF),
    "rf_importance": risk.forest_importances,
    "best_model": risk.best_model,
    "score_orders": risk.scored_orders,
    "cv_auc": lambda s: risk.cv_auc(s, models.LR),
    "cv_auc_forest": lambda s: risk.cv_auc(s, models.RF),
}


def queries(load: Callable[[SparkSession, str], SessionStar]) -> dict[str, Query]:
    """Every query as a function of a session and a directory, whose star `load` gives."""

    def bind(function) -> Query:
        return lambda spark, directory: function(load(spark, directory))

    return {name: bind(function) for name, function in {**FROM_RAW, **REPORTS}.items()}
