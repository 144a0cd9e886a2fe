"""Joins and numbering that survive a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key is hot when it holds at least this share of the rows: there can be at most 50 of them.
HOT_SHARE = 0.02


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Every value of `key` holding at least `share` of the rows (at most 1/share values).

    The frequent-items summary never misses such a value but may return others, so the
    candidates are counted exactly before they are believed.
    """
    keys = df.select(key).where(F.col(key).isNotNull())
    candidates = keys.freqItems([key], share / 2).first()[0]
    if not candidates:
        return []
    tagged = F.when(F.col(key).isin(candidates), F.col(key))
    counts = keys.groupBy(tagged.alias("candidate")).count().collect()
    total = sum(row["count"] for row in counts)
    return sorted(
        row["candidate"]
        for row in counts
        if row["candidate"] is not None and row["count"] >= share * total
    )


def is_hot(key: str, hot: Sequence) -> Column:
    """Rows of the hot keys; a plain list test, so that it reaches the file scan."""
    return F.col(key).isin(list(hot))


def is_ordinary(key: str, hot: Sequence) -> Column:
    """All other rows, those without a key included."""
    return F.col(key).isNull() | ~F.col(key).isin(list(hot))


def split_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    share: float = HOT_SHARE,
    hot: Sequence | None = None,
) -> DataFrame:
    """Join `left` to `right`, which holds one row per key, without overloading a task.

    Adaptive skew handling needs a fresh exchange under both sides; it does not apply when
    `right` was just aggregated by the key.  So rows of hot keys take a second route: the
    matching rows of `right`, at most 1/share of them, are broadcast and the hot rows of
    `left` stay where they are.  All other rows take the ordinary join.
    """
    hot = hot_keys(left, key, share) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    ordinary = left.where(is_ordinary(key, hot)).join(right.where(is_ordinary(key, hot)), key, how)
    few = F.broadcast(right.where(is_hot(key, hot)))
    return ordinary.unionByName(left.where(is_hot(key, hot)).join(few, key, how))


def number_within(
    df: DataFrame, key: str, second: str, rest: Sequence[str], name: str, share: float = HOT_SHARE
) -> DataFrame:
    """`row_number()` within `key` ordered by (`second`, `rest`).

    Hot keys are numbered per (key, second) and shifted by the count of rows under smaller
    `second` values, so no task has to hold all rows of one key.
    """
    plain = F.row_number().over(W.partitionBy(key).orderBy(second, *rest))
    hot = hot_keys(df, key, share)
    if not hot:
        return df.withColumn(name, plain)
    ordinary = df.where(is_ordinary(key, hot)).withColumn(name, plain)
    heavy = df.where(is_hot(key, hot))
    sizes = heavy.groupBy(key, second).agg(F.count("*").alias("_size"))
    running = W.partitionBy(key).orderBy(second).rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col(key).alias("_key"),
        F.col(second).alias("_second"),
        F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_shift"),
    )
    local = F.row_number().over(W.partitionBy(key, second).orderBy(*rest))
    numbered = (
        heavy.withColumn("_local", local)
        .join(
            shifts,
            F.col(key).eqNullSafe(F.col("_key")) & F.col(second).eqNullSafe(F.col("_second")),
        )
        .withColumn(name, (F.col("_local") + F.col("_shift")).cast("int"))
        .drop("_local", "_shift", "_key", "_second")
    )
    return ordinary.unionByName(numbered)
