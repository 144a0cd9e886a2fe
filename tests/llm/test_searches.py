import math

import numpy as np
import pytest
from llm_cases import SMALL
from pyspark.sql import functions as F

from orderlens.llm import exact_search, near_search

ODD = [
    (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.25, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [math.nan, 1.0]),
    (8, [math.inf, 1.0]), (None, [1.0, 1.0]), (9, []), (10, [1.0]), (3, [-0.25, 1.0]), (11, [1e30, 1.0]), (12, [-0.0, 2.0]),
]


def odd(spark):
    return spark.createDataFrame([(*r, "x") for r in ODD], "vec_id long, embedding array<double>, packed string")


def test_exact_search_on_odd_vectors(spark):
    rows = {i: [math.floor(64 * x) for x in v] for i, v in ODD if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = exact_search.top_k(odd(spark), F.col("vec_id") % 2 == 0, 4, 64.0).collect()
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q in (q for q in rows if q % 2 == 0):
        scores = sorted((-cut(sum(a * b for a, b in zip(rows[q], v))), i) for i, v in rows.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:4])]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("rows,queries", [(7, 3), (16_384, 2_048)])
def test_exact_search_in_blocks(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(exact_search, "ROW_BLOCK", rows)
    monkeypatch.setattr(exact_search, "QUERY_BLOCK", queries)
    random = np.random.default_rng(1)
    x = random.integers(-2, 3, (60, 6)) * (random.random((60, 6)) < 0.4)  # sparse, with many ties
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = exact_search.top_k(df, F.col("vec_id") < 10, 5, 1.0).collect()
    scores = x[:10] @ x.T
    want = [
        (q, k + 1, i, int(scores[q, i]))
        for q in range(10)
        for k, i in enumerate([i for i in np.lexsort((np.arange(60), -scores[q])).tolist() if i != q][:5])
    ]
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_search_recall_and_scores(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    rows = near_search.nearest(df, F.col("vec_id") % 10 == 0).collect()
    found = 0
    for q in (q for q in x if q % 10 == 0):
        exact = sorted((np.sqrt(((x[i] - x[q]) ** 2).sum()), i) for i in x if i != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(s == np.sqrt(((x[i] - x[q]) ** 2).sum()) for _, i, s in mine)
        assert mine == sorted(mine, key=lambda m: (m[2], m[1]))
        found += len({i for _, i in exact} & {m[1] for m in mine})
    assert found / (10 * sum(q % 10 == 0 for q in x)) >= 0.9


@pytest.mark.parametrize("blocks", [2, 8_192])
def test_near_search_on_odd_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_search, "ROW_BLOCK", blocks)
    monkeypatch.setattr(near_search, "QUERY_BLOCK", 1)
    got = sorted(map(tuple, near_search.nearest(odd(spark), F.col("vec_id").isin(1, 4, 5, 10, 12), k=10).collect()))
    far = lambda a, b: math.dist(a, b)
    one, three, twelve, huge = [0.5, 0.5], [-0.25, 1.0], [0.0, 2.0], [1e30, 1.0]
    want = []
    for q, v, others in (
        (1, one, {2: one, 3: three, 11: huge, 12: twelve}), (12, twelve, {1: one, 2: one, 3: three, 11: huge}),
    ):
        order = sorted((far(v, w), i) for i, w in others.items())
        want += [(q, k + 1, i) for k, (_, i) in enumerate(order)]
    assert [g[:3] for g in got] == sorted(want)


def test_near_search_finds_all_of_a_group_of_copies(spark):
    rows = [(i, [0.6, 0.8, 0.0]) for i in range(300)] + [(i, [1.0, float(i % 7), 0.3]) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = near_search.nearest(df, F.col("vec_id") == 50, k=5).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(k + 1, k, 0.0) for k in range(5)]


def test_empty_tables(spark):
    none = odd(spark).where("false")
    assert near_search.nearest(none, F.lit(True)).count() == 0
    assert exact_search.top_k(none, F.lit(True), 3, 64.0).count() == 0


def test_transform_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 8))
    turned = near_search.rotate(x, 3)
    assert np.allclose(turned @ turned.T, x @ x.T)
