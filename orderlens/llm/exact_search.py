"""Exact top-k by inner product: term-at-a-time accumulation into dense score arrays.

Components are terms, a row's non-zero components its weighted postings.  Rows and queries are cut
into blocks by a hash of their ids; each pair of a query block and a row block is one group.  There,
every term has a postings list over the block; a query adds, term after term, its weight times the
list into an array with one score for each row, then a partition (not a sort) selects its best k.
The few best of all blocks are merged by a window over each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.llm import vectors as vec

ROW_BLOCK = 16_384
QUERY_BLOCK = 2_048
LONG = 2**63 - 1


class Postings:
    """Term lists of a block; a list that covers most rows is kept as one weight for every row."""

    def __init__(self, packed: list[bytes]):
        sizes = np.array([len(p) // 8 for p in packed])
        self.rows = len(packed)
        owner = np.repeat(np.arange(self.rows), sizes)
        term = np.concatenate([np.arange(n) for n in sizes]) if self.rows else np.zeros(0, int)
        weight = np.frombuffer(b"".join(packed), np.float64)
        used = weight != 0
        owner, term, weight = owner[used], term[used], weight[used]
        self.largest = float(np.abs(weight).max(initial=0))
        order = np.argsort(term, kind="stable")
        self.terms, begin = np.unique(term[order], return_index=True)
        self.owner = np.split(owner[order], begin[1:])
        self.weight = np.split(weight[order], begin[1:])

    def of_kind(self, kind) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
        lists = {}
        for t, owner, weight in zip(self.terms.tolist(), self.owner, self.weight, strict=False):
            values = _whole(weight, kind)
            if 2 * len(owner) > self.rows:
                dense = np.zeros(self.rows, kind)
                dense[owner] = values
                lists[t] = (None, dense)
            else:
                lists[t] = (owner, values)
        return lists


def _whole(values: np.ndarray, kind) -> np.ndarray:
    return np.array([int(v) for v in values], object) if kind is object else values.astype(kind)


def accumulate(queries: list[bytes], postings: Postings) -> Iterator[np.ndarray]:
    """The scores of all rows of the block, for each query.

    Sums are exact: 32-bit where no sum can leave that range, else 64-bit, else Python integers.
    """
    rows = [np.frombuffer(q, np.float64) for q in queries]
    most = max((float(np.abs(q).max(initial=0)) for q in rows), default=0.0)
    width = max((len(q) for q in rows), default=0)
    bound = int(most) * int(postings.largest) * max(1, width)
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    lists = postings.of_kind(kind)
    for row in rows:
        scores = np.zeros(postings.rows, kind)
        for term in np.flatnonzero(row).tolist():
            if term in lists:
                owner, weight = lists[term]
                factor = int(row[term]) if kind is object else kind(row[term])
                if owner is None:
                    scores += factor * weight
                else:
                    scores[owner] += factor * weight  # a row occurs once in a list
        yield scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; `ids` ascend."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def top_k(
    df: DataFrame, is_query: Column, k: int, scale: float, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k highest integer inner products of floor(scale * x).

    `is_query` is a condition on `vec_id`; a query's candidates are all rows but its own.  Rows
    without an id, null vectors and vectors with null or non-finite components take no part; an
    empty vector scores 0; missing components of a shorter vector count as 0; of rows with one id a
    single one counts.  Scores beyond a long are cut to its range.  Other columns are not read.
    """
    rows = vec.packed(df, vec_id, vector, scale)
    queries = rows.where(is_query)
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = vec.blocks(n_rows, ROW_BLOCK), vec.blocks(n_queries, QUERY_BLOCK)
    left = queries.select("*", vec.block_of("vec_id", query_blocks, "query").alias("qb"), vec.every(row_blocks).alias("rb"))
    right = rows.select("*", vec.block_of("vec_id", row_blocks, "row").alias("rb"), vec.every(query_blocks).alias("qb"))

    def search(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id")
        ids = block["vec_id"].to_numpy()
        asked = asked.sort_values("vec_id")
        postings = Postings(block["packed"].to_list())
        out = []
        for query, scores in zip(asked["vec_id"].tolist(), accumulate(asked["packed"].to_list(), postings), strict=True):
            at = best(scores, ids, k + 1)  # one more, since the query's own row may be among them
            at = at[ids[at] != query]
            value = [max(-LONG - 1, min(LONG, int(s))) for s in scores[at]]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": value}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(
        search, "query_id long, vec_id long, score long"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
