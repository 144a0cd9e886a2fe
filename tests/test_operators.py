import random

import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.operators import order_stats
from orderlens.operators.order_stats import (
    exact_medians,
    order_statistics,
    tile_starts,
    with_tiles,
)
from orderlens.operators.ranks import mid_ranks, rank_sums, tie_term, value_counts
from orderlens.sources.scratch import materialize
from orderlens.operators.skew import hot_keys, number_within, split_join


def _people(spark, n, seed=1):
    draw = random.Random(seed)
    data = [(f"c{i:05d}", draw.choice([1, 1, 1, 1, 2]), draw.randrange(50) / 4) for i in range(n)]
    return spark.createDataFrame(data, "id string, visits int, spend double")


def test_tiles_of_seven_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "v int")
    tiled = with_tiles(df, {"t": (5, ["v"])}, "tiles")
    sizes = [r["count"] for r in tiled.groupBy("t").count().orderBy("t").collect()]
    assert sizes == [2, 2, 1, 1, 1]
    assert tile_starts(7, 5) == [3, 5, 6, 7]


@pytest.mark.parametrize("n", [0, 1, 3, 5, 400])
def test_tiles_equal_ntile(spark, n):
    df = _people(spark, n)
    keys = ["visits", "spend", "id"]
    ours = with_tiles(df, {"t": (5, keys)}, "tiles", bracket_rows=20, sample_rows=50)
    theirs = df.withColumn("t", F.ntile(5).over(W.orderBy(*keys)))
    assert sorted(rows(ours)) == sorted(rows(theirs))


def test_narrowing_finds_exact_rows(spark):
    df = _people(spark, 3000, seed=2).repartition(4)
    keys = ["spend", "id"]
    wanted = [1, 2, 750, 1500, 1501, 2999, 3000]
    found = order_statistics(df, keys, wanted, 3000, bracket_rows=10, sample_rows=100)
    ordered = sorted((r["spend"], r["id"]) for r in df.collect())
    assert [tuple(r) for r in found] == [ordered[p - 1] for p in wanted]


def test_nulls_order_first(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c")], "v int, id string")
    found = order_statistics(df, ["v", "id"], [1, 2, 3], 3)
    assert [tuple(r) for r in found] == [(None, "a"), (1, "c"), (2, "b")]


def test_exact_medians(spark):
    data = [(3, None, 1.5, None), (1, 4.0, None, None), (2, 1.0, 2.5, None), (9, 3.0, 0.5, None)]
    rows_ = [(*v, i) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows_, "a int, b double, c double, d double, id int")
    assert exact_medians(df, ["a", "b", "c", "d"], ["id"]) == {"a": 2.5, "b": 3.0, "c": 1.5}
    assert exact_medians(df, [], ["id"]) == {}


def test_medians_of_many_columns_share_their_passes(spark):
    """Ties, nulls and brackets that must be narrowed; more columns cost no more jobs."""
    columns = [f"c{i}" for i in range(6)]
    value = lambda i: F.when(F.rand(i) < 0.9, F.floor(F.randn(i + 50) * 10 ** (i % 3)))
    df = spark.range(4000).select("id", *[value(i).alias(c) for i, c in enumerate(columns)])
    df = materialize(df, "values")
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    jobs = {}
    for n in (1, 6):
        context.setJobGroup(f"medians of {n}", "")
        found = exact_medians(df, columns[:n], ["id"], bracket_rows=20, sample_rows=200)
        jobs[n] = len(tracker.getJobIdsForGroup(f"medians of {n}"))
        context.setLocalProperty("spark.jobGroup.id", None)
        want = df.agg(*[F.median(c).alias(c) for c in columns[:n]]).first().asDict()
        assert found == want
    assert jobs[6] <= jobs[1] + 8  # a pass or two more, where a column needs it


def test_mid_ranks_of_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    ranks = mid_ranks(value_counts(df, "v"), "v").orderBy("v")
    assert rows(ranks) == [(1.0, 1, 1.0), (2.0, 2, 2.5), (3.0, 1, 4.0)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-300, 300), st.sampled_from("ab")), min_size=1, max_size=60))
def test_mid_ranks_equal_pandas(spark, data):
    pairs = [(v / 100, g) for v, g in data]
    counts = value_counts(spark.createDataFrame(pairs, "v double, g string"), "g", "v")
    frame = pd.DataFrame(pairs, columns=["v", "g"])
    frame["rank"] = frame["v"].rank()
    expected = frame.groupby("g")["rank"].agg(["size", "sum"])
    ours = {r["g"]: (r["n"], r["rank_sum"]) for r in rank_sums(counts, "v", "g").collect()}
    assert ours == {g: (row["size"], row["sum"]) for g, row in expected.iterrows()}
    ties = frame["v"].value_counts()
    assert tie_term(counts, "v").first()["tie_term"] == float((ties**3 - ties).sum())


def _skewed(spark):
    data = [("hot", i) for i in range(400)] + [(f"k{i}", i) for i in range(600)] + [(None, 1)]
    return spark.createDataFrame(data, "k string, v int").repartition(4)


def test_hot_keys_are_only_the_frequent_ones(spark):
    assert hot_keys(_skewed(spark), "k", 0.1) == ["hot"]
    assert hot_keys(_skewed(spark).where("k <> 'hot'"), "k", 0.1) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_join(spark, how):
    left = _skewed(spark)
    right = spark.createDataFrame(
        [("hot", 1.0), ("k1", 2.0), ("k2", 3.0), ("other", 4.0)], "k string, w double"
    )
    ours = split_join(left, right, "k", how, share=0.1)
    theirs = left.join(right, "k", how)
    assert ours.columns == theirs.columns
    assert sorted(map(str, rows(ours))) == sorted(map(str, rows(theirs)))


def test_numbering_of_a_hot_key(spark):
    data = [("hot", i % 7, i) for i in range(300)] + [(f"k{i % 50}", i % 3, i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, a int, b int").repartition(4)
    ours = number_within(df, "k", "a", ["b"], "n", share=0.1)
    theirs = df.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("a", "b")))
    assert sorted(rows(ours)) == sorted(rows(theirs))
    assert ours.schema["n"].dataType == theirs.schema["n"].dataType


def test_positions_that_cannot_be_narrowed_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "MAX_PASSES", 0)
    df = spark.range(100)
    with pytest.raises(RuntimeError, match="not narrowed"):
        order_stats.order_statistics(df, ["id"], [50], 100, bracket_rows=10)
