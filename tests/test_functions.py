import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from orderlens.functions import pvalues
from orderlens.functions.buckets import (
    DELAY_BOUNDS,
    DELAY_LABELS,
    WEIGHT_BOUNDS,
    WEIGHT_LABELS,
    bucket_label,
    bucket_order,
    magnitude,
)
from orderlens.functions.exact import exact_mean, exact_sum, half_even, half_up, percent


def test_rounding_rules(spark):
    df = spark.createDataFrame([(0.005,), (0.125,), (1.005,), (2.675,), (-0.005,), (0.015,)], "x double")
    half_ups = [r[0] for r in df.select(half_up(F.col("x"), 2)).collect()]
    assert half_ups == [0.01, 0.13, 1.01, 2.68, -0.01, 0.02]
    # Scaling first makes 1.005 fall below the tie and lifts 2.675 onto an even one.
    half_evens = [r[0] for r in df.select(half_even(F.col("x"))).collect()]
    assert half_evens == [0.0, 0.12, 1.0, 2.68, -0.0, 0.02]


def test_exact_sums_ignore_order(spark):
    values = [0.1, 0.2, 0.3, 1e9, -1e9, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert rows(df.agg(exact_sum("x"), exact_mean("x"))) == [(0.6, 0.12)]
    assert rows(df.where("x is null").agg(exact_sum("x"), exact_mean("x"))) == [(None, None)]


def test_percent_of_nothing(spark):
    df = spark.range(1).select(percent(F.lit(1), F.lit(4)), percent(F.lit(1), F.lit(0)))
    assert rows(df) == [(25.0, None)]


@pytest.mark.parametrize(
    "value, label",
    [(-7.0, "7+ days early"), (-6.99, "3-7 days early"), (0.0, "0-3 days early"),
     (0.01, "1-3 days late"), (3.0, "1-3 days late"), (14.0, "7-14 days late"),
     (14.01, "14+ days late"), (None, None)],
)
def test_delay_buckets_close_on_the_right(spark, value, label):
    df = spark.createDataFrame([(value,)], "x double")
    order = bucket_order(F.col("x"), DELAY_BOUNDS)
    assert rows(df.select(bucket_label(order, DELAY_LABELS))) == [(label,)]


def test_weight_buckets(spark):
    df = spark.createDataFrame([(500.0,), (501.0,), (10000.0,), (10001.0,)], "x double")
    order = bucket_order(F.col("x"), WEIGHT_BOUNDS)
    assert [r[0][:2] for r in rows(df.select(bucket_label(order, WEIGHT_LABELS)))] == [
        "1:", "2:", "4:", "5:"
    ]


def test_magnitude_bands(spark):
    bands = ((0.2, "negligible"), (0.5, "small"))
    df = spark.createDataFrame([(0.1,), (-0.2,), (0.5,), (None,)], "x double")
    assert [r[0] for r in rows(df.select(magnitude(F.col("x"), bands, "large")))] == [
        "negligible", "small", "large", None
    ]


def values(spark, *ps):
    """Tail probabilities of literals, without a table."""
    return list(spark.range(1).select(*[p.alias(f"p{i}") for i, p in enumerate(ps)]).first())


def lit(function, *values, **kw):
    return function(*[F.lit(float(v)) for v in values], **kw)


# Printed statistical tables.
PRINTED = [
    (pvalues.p_t, (2.228, 10), 0.05),
    (pvalues.p_t, (-12.706, 1), 0.05),
    (pvalues.p_t, (1.96, 1e7), 0.05),
    (pvalues.p_f, (3.3258, 5, 10), 0.05),
    (pvalues.p_f, (4.0012, 1, 60), 0.05),
    (pvalues.p_chi2, (3.841, 1), 0.05),
    (pvalues.p_chi2, (16.919, 9), 0.05),
    (pvalues.p_chi2, (21.666, 9), 0.01),
    (pvalues.p_normal, (1.959964,), 0.05),
    (pvalues.p_normal, (-0.3,), 1.0),
    (pvalues.p_f, (0.0, 2, 3), 1.0),
    (pvalues.p_chi2, (0.0, 3), 1.0),
    (pvalues.p_t, (0.0, 5), 1.0),
]


def test_tail_probabilities(spark):
    found = values(spark, *[lit(function, *given) for function, given, _ in PRINTED])
    assert found == pytest.approx([p for *_, p in PRINTED], rel=2e-3)


def test_tails_of_known_form(spark):
    """Distributions with closed tails, to nearly all digits."""
    zs = (0.1, 1.0, 3.0, 8.0, 20.0)
    for function, more, closed in (
        (pvalues.p_normal, (), lambda z: math.erfc(z / math.sqrt(2))),
        (pvalues.p_chi2, (2,), lambda z: math.exp(-z / 2)),
        (pvalues.p_t, (1,), lambda z: 2 / math.pi * math.atan(1 / z)),
        (pvalues.p_t, (2,), lambda z: 2 / (math.sqrt(z * z + 2) * (math.sqrt(z * z + 2) + z))),
        (pvalues.p_f, (2, 7), lambda z: (1 + 2 * z / 7) ** -3.5),
    ):
        assert values(spark, *[lit(function, z, *more) for z in zs]) == pytest.approx([closed(z) for z in zs], rel=1e-9)
    zs = (0.5, 1.0, 7.3, 1e3, 5e6)
    found = values(spark, *[lit(pvalues.log_gamma, z) for z in zs])
    assert found == pytest.approx([math.lgamma(z) for z in zs], rel=1e-13, abs=1e-12)


def test_tails_of_extreme_statistics(spark):
    assert max(values(spark, lit(pvalues.p_t, 90.3, 9000), lit(pvalues.p_chi2, 18770.0, 9))) < 1e-300


def test_p_columns_pass_nulls(spark):
    df = spark.createDataFrame([(2.228, 10.0), (None, 10.0)], "t double, df double")
    p = [r[0] for r in df.select(pvalues.p_t(F.col("t"), F.col("df"))).collect()]
    assert p[0] == pytest.approx(0.05, rel=2e-3) and p[1] is None


def test_tails_at_many_degrees_of_freedom(spark):
    # Both ways to compute them meet, and the limits are reached.
    for df in (1e5, 1e7, 1e13):
        made = [(pvalues.p_t, (t,)) for t in (0.5, 2.0, 12.0)] + [(pvalues.p_f, (f, 9)) for f in (0.8, 1.5, 9.0)]
        at, edge = (values(spark, *[lit(f, *v, d) for f, v in made]) for d in (df, df * (1 - 1e-9)))
        assert at == pytest.approx(edge, rel=1e-8)
    assert at[1] == pytest.approx(0.04550026389635842, rel=1e-8)
    assert at[4] == pytest.approx(values(spark, lit(pvalues.p_chi2, 13.5, 9))[0], rel=1e-8)


def test_what_does_not_converge_is_null(spark):
    assert values(spark, lit(pvalues.p_t, 2.0, 1000, terms=4), lit(pvalues.p_chi2, 500.0, 400, terms=4)) == [None, None]
