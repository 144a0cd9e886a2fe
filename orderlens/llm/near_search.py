"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table rotates unit vectors pseudo-randomly (three rounds of random signs and a fast Hadamard
transform) and assigns each to the nearest signed axis, which is the largest component with its
sign.  A query probes, in every table, the axes nearest to its own rotation; the rows found there are
ranked exactly, by Euclidean distance on the original vectors.

Every row is in every table.  One (table, axis) group is searched at a time, split into blocks where
it holds many rows or queries, so no group grows with the data.  A group returns only the k nearest
of each query; these few are merged.  Queries that met fewer than k rows are searched again,
exactly, over all rows in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.llm import vectors as vec
from orderlens.sources.scratch import materialize

TABLES = 6
PROBES = 16
ROW_BLOCK = 8_192
QUERY_BLOCK = 1_024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast transform of each row; the width is a power of two."""
    n = x.shape[1]
    half = 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation of each row, at the next power of two of its width."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for signs in np.random.default_rng([table, width]).choice([-1.0, 1.0], (3, width)):
        x = hadamard(x * signs)
    return x


def nearest_axes(x: np.ndarray, table: int, n: int) -> np.ndarray:
    """The n signed axes nearest to each row, nearest first: 2 * axis, plus one where negative."""
    turned = rotate(x, table)
    signed = np.stack([turned, -turned], axis=2).reshape(len(x), -1)
    n = min(n, signed.shape[1])
    near = np.argpartition(-signed, n - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(signed, near, 1), axis=1, kind="stable"), 1)


def _assigned(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """One row for each table and probe, with the number of components and the axis."""

    def work(batches):
        for batch in batches:
            ids, raw = batch.column(0), batch.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, p in enumerate(raw):
                by_size.setdefault(len(p) // 8, []).append(i)
            for size, at in by_size.items():
                x = vec.unpack([raw[i] for i in at])
                # Scaled by the largest component first, so that squares neither overflow nor vanish.
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                for table in range(tables):
                    axes = nearest_axes(x, table, probes)
                    take = pa.array(np.repeat(at, axes.shape[1]))
                    n = axes.size
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(take), batch.column(1).take(take), pa.array(np.full(n, size, np.int32)),
                            pa.array(np.full(n, table, np.int32)), pa.array(axes.ravel().astype(np.int32)),
                        ],
                        names=["vec_id", "packed", "size", "tab", "axis"],
                    )

    return rows.mapInArrow(work, "vec_id long, packed binary, size int, tab int, axis int")


def _nearest(k: int):
    def search(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(block):
            block = block.sort_values("vec_id")
            ids, x = block["vec_id"].to_numpy(), vec.unpack(block["packed"].to_list())
            for query, packed in zip(asked["vec_id"].tolist(), asked["packed"], strict=True):
                difference = x - np.frombuffer(packed, np.float64)
                largest = np.abs(difference).max(axis=1, initial=0.0)
                safe = np.where((largest > 1e100) | (largest < 1e-100), np.maximum(largest, 1e-300), 1.0)
                score = np.sqrt(((difference / safe[:, None]) ** 2).sum(axis=1)) * safe
                score[ids == query] = np.inf
                n = min(k, len(ids))
                edge = np.partition(score, n - 1)[n - 1]
                at = np.flatnonzero(score <= edge)
                at = at[np.argsort(score[at], kind="stable")][:n]
                at = at[ids[at] != query]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": score[at]}))
        if not out:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.concat(out)

    return search


FOUND = "query_id long, vec_id long, score double"


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    tables: int = TABLES,
    probes: int = PROBES,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k nearest rows found for each query.

    `is_query` is a condition on `vec_id`; a query's candidates are all rows but its own, ties go to
    the smaller id.  Rows without an id, null vectors, zero vectors, empty ones and those with null
    or non-finite components take no part; of rows with one id a single one counts.  Vectors are
    compared with those of as many components.  Other columns are not read.
    """
    nonzero = F.exists(vector, lambda x: x != 0)
    rows = vec.packed(df.where(nonzero), vec_id, vector)
    queries = rows.where(is_query)
    key = ["size", "tab", "axis"]
    index = materialize(_assigned(rows, tables, 1), "near_index")
    probe = materialize(_assigned(queries, tables, probes), "near_probes")
    # At most one row for each table and axis: the two counts decide into how many blocks it is cut.
    counts = index.groupBy(*key).agg(F.count("*").alias("n")).join(
        probe.groupBy(*key).agg(F.count("*").alias("q")), key
    ).select(
        *key,
        F.ceil(F.col("n") / ROW_BLOCK).cast("int").alias("rbs"),
        F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qbs"),
    )
    counts = materialize(counts, "near_blocks")
    cut = [*key, "rb", "qb"]
    left = probe.join(F.broadcast(counts), key).select(
        "*", vec.block_of("vec_id", F.col("qbs"), "query").alias("qb"), vec.every(F.col("rbs")).alias("rb")
    )
    right = index.join(F.broadcast(counts), key).select(
        "*", vec.block_of("vec_id", F.col("rbs"), "row").alias("rb"), vec.every(F.col("qbs")).alias("qb")
    )
    columns = ["vec_id", "packed", *cut]
    near = left.select(columns).groupBy(*cut).cogroup(right.select(columns).groupBy(*cut)).applyInPandas(_nearest(k), FOUND)
    found = materialize(_ranked(near, k), "near_found")
    # Queries that met fewer than k rows: all rows, in blocks.
    sizes = rows.groupBy((F.length("packed") / 8).alias("size")).count()
    met = found.groupBy("query_id").agg(F.count("*").alias("met"))
    short = (
        queries.join(met, queries["vec_id"] == met["query_id"], "left")
        .withColumn("size", F.length("packed") / 8)
        .join(sizes, "size")
        .where(F.coalesce("met", F.lit(0)) < F.least(F.lit(k), F.col("count") - 1))
        .select("vec_id", "packed")
    )
    short = materialize(short, "near_short")
    n_short = short.count()
    if n_short:
        exact = _all_rows(short, rows, n_short, rows.count(), k)
        found = materialize(_ranked(found.drop("rank").unionByName(exact), k), "near_all")
    return found.select("query_id", "rank", "vec_id", "score")


def _all_rows(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, k: int) -> DataFrame:
    """The k nearest of all rows, by pairs of blocks."""
    rbs, qbs = vec.blocks(n_rows, ROW_BLOCK), vec.blocks(n_queries, QUERY_BLOCK)
    size = (F.length("packed") / 8).cast("int").alias("size")
    cut = ["size", "rb", "qb"]
    left = queries.select("*", size, vec.block_of("vec_id", qbs, "query").alias("qb"), vec.every(rbs).alias("rb"))
    right = rows.select("*", size, vec.block_of("vec_id", rbs, "row").alias("rb"), vec.every(qbs).alias("qb"))
    return left.groupBy(*cut).cogroup(right.groupBy(*cut)).applyInPandas(_nearest(k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; a row met in several tables counts once."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
