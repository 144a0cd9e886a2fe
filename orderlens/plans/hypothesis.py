"""Hypothesis tests on delivery times and review scores.

Every statistic is finished from grouped moments or from counts of distinct values, so the
items themselves are scanned once and never ranked, sorted or collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.buckets import (
    DELAY_CLASS_BOUNDS,
    DELAY_CLASS_LABELS,
    bucket_label,
    bucket_order,
    magnitude,
)
from orderlens.functions.draws import seeded_draw
from orderlens.functions.exact import exact_mean
from orderlens.functions.pvalues import p_chi2, p_f, p_normal, p_t
from orderlens.operators.ranks import mid_ranks, rank_sums, tie_term, value_counts
from orderlens.plans.common import delivered_dated, with_state
from orderlens.sources.scratch import materialize

# Verbal bands, the normal quantile of the intervals, significance levels.
CORRELATION_BANDS = ((0.1, "negligible"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong"))
CORRELATION_TOP = "very strong"
EFFECT_BANDS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
ETA_BANDS = ((0.06, "small"), (0.14, "medium"))
EFFECT_TOP = "large"
Z95 = 1.96
ALPHAS = (0.05, 0.01)

TEST_COLUMNS = (
    "order_id", "order_item_id", "is_late", "review_score", "delivery_days",
    "delivery_delay_days",
)


def test_rows(star) -> DataFrame:
    """Delivered, dated and reviewed items with the state of a known customer.

    All tests share these rows, so the join is done and written once per star.
    """

    def build() -> DataFrame:
        reviewed = delivered_dated(star.fact).where(F.col("review_score").isNotNull())
        narrow = reviewed.select("customer_unique_id", *TEST_COLUMNS)
        rows = with_state(narrow, star.customers)
        return materialize(rows.select(*TEST_COLUMNS, "customer_state"), "test_rows")

    return star.once("test_rows", build)


def counted(star, *columns: str) -> DataFrame:
    """Test rows per distinct combination of `columns`, written once.

    Rank statistics and quartiles read these counts several times; the rows only once.
    """
    return star.once(
        "counts of " + ", ".join(columns),
        lambda: materialize(value_counts(test_rows(star), *columns), "counts"),
    )


def _significance(df: DataFrame, p: Column) -> DataFrame:
    return df.withColumn("p", p).withColumns(
        {
            "significant": F.col("p") < F.lit(ALPHAS[0]),
            "significant_01": F.col("p") < F.lit(ALPHAS[1]),
        }
    )


def _describe_correlation(df: DataFrame) -> DataFrame:
    r = F.col("r")
    return df.withColumns(
        {
            "strength": magnitude(r, CORRELATION_BANDS, CORRELATION_TOP),
            "direction": F.when(r < 0, "negative").when(r >= 0, "positive"),
        }
    )


def _with_correlation_p(df: DataFrame) -> DataFrame:
    r, df2 = F.col("r"), F.col("n") - F.lit(2)
    t = r * F.sqrt(F.try_divide(df2.cast("double"), F.lit(1.0) - r * r))
    return _significance(df, p_t(t, df2))


# --- correlation of delay and review -------------------------------------------------------


def pearson(star) -> DataFrame:
    return _with_correlation_p(
        _describe_correlation(
            test_rows(star).agg(
                F.count("*").alias("n"), F.corr("delivery_delay_days", "review_score").alias("r")
            )
        )
    )


def spearman(star) -> DataFrame:
    """Pearson correlation of mid-ranks, from the joint counts of (delay, score)."""
    joint = counted(star, "delivery_delay_days", "review_score")
    x = mid_ranks(joint, "delivery_delay_days").select(
        "delivery_delay_days", F.col("mid_rank").alias("x")
    )
    y = mid_ranks(joint, "review_score").select("review_score", F.col("mid_rank").alias("y"))
    n = F.col("n")
    ranked = joint.join(x, "delivery_delay_days").join(y, "review_score")
    # Ranks average (N + 1) / 2, so the centred moments need one pass over the counts.
    centred = ranked.withColumn(
        "centre", (joint.agg(F.sum("n")).scalar() + F.lit(1)) / F.lit(2.0)
    ).withColumns({"x": F.col("x") - F.col("centre"), "y": F.col("y") - F.col("centre")})
    x, y = F.col("x"), F.col("y")
    moments = centred.agg(
        F.sum("n").alias("n"),
        F.sum(n * x * y).alias("xy"),
        F.sum(n * x * x).alias("xx"),
        F.sum(n * y * y).alias("yy"),
    )
    rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    return _with_correlation_p(_describe_correlation(moments.select("n", rho.alias("r"))))


def regression_line(star) -> DataFrame:
    return test_rows(star).agg(
        F.regr_slope("review_score", "delivery_delay_days").alias("slope"),
        F.regr_intercept("review_score", "delivery_delay_days").alias("intercept"),
    )


def scatter_sample(star, rows: int = 5000, seed: int = 42) -> DataFrame:
    """`rows` items drawn by a seeded hash of their key: the same items on every run and engine."""
    draw = seeded_draw(["order_id", "order_item_id"], seed)
    return (
        test_rows(star)
        .orderBy(draw, "order_id", "order_item_id")
        .limit(rows)
        .select("delivery_delay_days", "review_score")
    )


# --- on-time against late reviews ----------------------------------------------------------


def late_group_stats(star) -> DataFrame:
    return (
        test_rows(star)
        .groupBy("is_late")
        .agg(
            F.count("*").alias("n"),
            F.avg("review_score").alias("mean"),
            F.stddev_samp("review_score").alias("sd"),
            F.percentile("review_score", 0.5).alias("median"),
        )
        .orderBy("is_late")
    )


def _two_groups(star) -> DataFrame:
    """n, mean and variance of both groups side by side in one row."""

    def of(late: int, suffix: str) -> list[Column]:
        score = F.when(F.col("is_late") == late, F.col("review_score"))
        return [
            F.count(score).alias(f"n{suffix}"),
            F.avg(score).alias(f"mean{suffix}"),
            F.var_samp(score).alias(f"var{suffix}"),
        ]

    return test_rows(star).agg(*of(0, "1"), *of(1, "2"))


def _standard_errors() -> tuple[Column, Column]:
    return (
        F.try_divide(F.col("var1"), F.col("n1")),
        F.try_divide(F.col("var2"), F.col("n2")),
    )


def welch_t(star) -> DataFrame:
    e1, e2 = _standard_errors()
    spread = e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1)
    found = _two_groups(star).select(
        F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(e1 + e2)).alias("t"),
        F.try_divide((e1 + e2) * (e1 + e2), spread).alias("df"),
    )
    return _significance(found, p_t(F.col("t"), F.col("df")))


def cohens_d(star) -> DataFrame:
    pooled = F.try_divide(
        (F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"),
        F.col("n1") + F.col("n2") - 2,
    )
    d = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled))
    return _two_groups(star).select(d.alias("d")).withColumn(
        "band", magnitude(F.col("d"), EFFECT_BANDS, EFFECT_TOP)
    )


def mean_diff_ci(star) -> DataFrame:
    """Difference of the means and the mean of each group, with 95% intervals."""
    e1, e2 = _standard_errors()
    parts = {
        "difference": (F.col("mean1") - F.col("mean2"), F.sqrt(e1 + e2)),
        "on_time": (F.col("mean1"), F.sqrt(e1)),
        "late": (F.col("mean2"), F.sqrt(e2)),
    }
    rows = [
        F.struct(
            F.lit(name).alias("quantity"),
            value.alias("value"),
            se.alias("se"),
            (value - Z95 * se).alias("ci_low"),
            (value + Z95 * se).alias("ci_high"),
        )
        for name, (value, se) in parts.items()
    ]
    return _two_groups(star).select(F.inline(F.array(*rows)))


def mann_whitney(star) -> DataFrame:
    """U of the on-time group with its tie-corrected, continuity-corrected z."""
    counts = counted(star, "is_late", "review_score")
    sums = rank_sums(counts, "review_score", "is_late")

    def of(late: int, name: str) -> Column:
        return F.sum(F.when(F.col("is_late") == late, F.col(name))).cast("double")

    ties = tie_term(counts, "review_score").select("tie_term").scalar()
    n1, n2, r1 = F.col("n1"), F.col("n2"), F.col("r1")
    total = n1 + n2
    u = r1 - n1 * (n1 + 1) / 2
    spread = F.sqrt(
        n1 * n2 / F.lit(12.0) * (total + 1 - F.col("ties") / (total * (total - 1)))
    )
    larger = F.greatest(u, n1 * n2 - u)
    found = (
        sums.agg(of(0, "n").alias("n1"), of(1, "n").alias("n2"), of(0, "rank_sum").alias("r1"))
        .withColumn("ties", ties)
        .select(
            u.alias("u"),
            F.try_divide(larger - n1 * n2 / 2 - F.lit(0.5), spread).alias("z"),
        )
    )
    return _significance(found, p_normal(F.col("z")))


# --- delivery time across states -----------------------------------------------------------


def top_states(star, states: int = 10) -> DataFrame:
    return (
        counted(star, "customer_state", "delivery_days")
        .groupBy("customer_state")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "customer_state")
        .limit(states)
        .select("customer_state")
    )


def anova_groups(star, states: int = 10) -> DataFrame:
    """The states with most items: n, mean, sd and median of the delivery days.

    All states are summarised in the one pass that also finds the largest.  Day counts have
    two decimals, so the distinct values an exact median keeps are few.
    """
    return (
        test_rows(star)
        .groupBy("customer_state")
        .agg(
            F.count("*").alias("n"),
            exact_mean("delivery_days").alias("mean"),
            F.stddev_samp("delivery_days").alias("sd"),
            F.percentile("delivery_days", 0.5).alias("median"),
        )
        .orderBy(F.desc("n"), "customer_state")
        .limit(states)
    )


def anova(star, states: int = 10) -> DataFrame:
    """One-way F, its p-value and eta squared from the group sizes, means and variances."""
    n, mean, sd = F.col("n"), F.col("mean"), F.col("sd")
    groups = anova_groups(star, states)
    # The few groups are read twice: squares of deviations, unlike differences of squares, do not cancel.
    grand = groups.agg(F.sum(n * mean) / F.sum("n")).scalar()
    away = mean - F.col("grand")
    sums = groups.withColumn("grand", grand).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("total"),
        F.sum(n * away * away).alias("between"),
        F.sum((n - 1) * sd * sd).alias("within"),
    )
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    found = sums.select(
        F.try_divide(F.col("between") / df1, F.col("within") / df2).alias("f"),
        df1.alias("df1"),
        df2.alias("df2"),
        F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("eta_squared"),
    ).withColumn("band", magnitude(F.col("eta_squared"), ETA_BANDS, EFFECT_TOP))
    return _significance(found, p_f(F.col("f"), F.col("df1"), F.col("df2")))


def kruskal(star, states: int = 10) -> DataFrame:
    """Tie-corrected H over the states with most items."""
    counts = counted(star, "customer_state", "delivery_days").join(
        top_states(star, states), "customer_state", "left_semi"
    )
    ties = tie_term(counts, "delivery_days").select("tie_term").scalar()
    total = F.col("total")
    h = F.lit(12.0) / (total * (total + 1)) * F.col("squares") - F.lit(3.0) * (total + 1)
    correction = F.lit(1.0) - F.col("ties") / (total * total * total - total)
    found = (
        rank_sums(counts, "delivery_days", "customer_state")
        .agg(
            F.count("*").alias("k"),
            F.sum("n").cast("double").alias("total"),
            F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("squares"),
        )
        .withColumn("ties", ties)
        .select(F.try_divide(h, correction).alias("h"), (F.col("k") - 1).alias("df"))
    )
    return _significance(found, p_chi2(F.col("h"), F.col("df")))


def state_mean_ci(star, states: int = 10) -> DataFrame:
    se = F.col("sd") / F.sqrt("n")
    return (
        anova_groups(star, states)
        .withColumns({"se": se, "ci": Z95 * se})
        .orderBy(F.desc("mean"), "customer_state")
    )


# --- box summaries -------------------------------------------------------------------------


def box_summary(counts: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles per group and the extreme values within 1.5 interquartile ranges of them,
    from counts `n` per (group, value)."""
    quartiles = counts.groupBy(group).agg(
        F.percentile(value, [0.25, 0.5, 0.75], F.col("n")).alias("q")
    )
    iqr = F.col("q")[2] - F.col("q")[0]
    inside = F.col(value).between(F.col("q")[0] - 1.5 * iqr, F.col("q")[2] + 1.5 * iqr)
    return (
        counts.join(quartiles, group)
        .groupBy(group)
        .agg(
            F.first("q").alias("q"),
            F.min(F.when(inside, F.col(value))).cast("double").alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).cast("double").alias("whisker_high"),
        )
        .select(
            group,
            F.col("q")[0].alias("q1"),
            F.col("q")[1].alias("median"),
            F.col("q")[2].alias("q3"),
            "whisker_low",
            "whisker_high",
        )
    )


def box_by_delay(star) -> DataFrame:
    bucket = bucket_order(F.col("delivery_delay_days"), DELAY_CLASS_BOUNDS).alias("bucket")
    classed = (
        counted(star, "delivery_delay_days", "review_score")
        .where(F.col("delivery_delay_days").isNotNull())
        .groupBy(bucket, "review_score")
        .agg(F.sum("n").alias("n"))
    )
    return (
        box_summary(classed, "bucket", "review_score")
        .orderBy("bucket")
        .withColumn("class", bucket_label(F.col("bucket"), DELAY_CLASS_LABELS))
        .select("class", "q1", "median", "q3", "whisker_low", "whisker_high")
    )


def box_by_state(star, states: int = 10) -> DataFrame:
    counts = counted(star, "customer_state", "delivery_days").join(
        top_states(star, states), "customer_state", "left_semi"
    )
    return box_summary(counts, "customer_state", "delivery_days").withColumnRenamed(
        "customer_state", "class"
    )


# --- summary -------------------------------------------------------------------------------


def summary(star) -> DataFrame:
    """One row per test: statistic, degrees of freedom, p-value, significance at 5% and 1%."""
    none = F.lit(None).cast("double")

    def row(df: DataFrame, name: str, statistic: str, df1=none, df2=none) -> DataFrame:
        return df.select(
            F.lit(name).alias("test"),
            F.col(statistic).cast("double").alias("statistic"),
            df1.cast("double").alias("df1"),
            df2.cast("double").alias("df2"),
            "p", "significant", "significant_01",
        )

    rows = [
        row(pearson(star), "pearson", "r", F.col("n") - 2),
        row(spearman(star), "spearman", "r", F.col("n") - 2),
        row(welch_t(star), "welch_t", "t", F.col("df")),
        row(mann_whitney(star), "mann_whitney", "u"),
        row(anova(star), "anova", "f", F.col("df1"), F.col("df2")),
        row(kruskal(star), "kruskal", "h", F.col("df")),
    ]
    return reduce(DataFrame.unionByName, rows)
