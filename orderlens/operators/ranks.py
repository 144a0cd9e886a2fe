"""Mid-ranks from value counts, so ranking cost follows distinct values, not rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.sources.scratch import materialize


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per distinct combination of `columns`, as column `n`."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


# Distinct values that one range partition holds, about.
RANGE_ROWS = 100_000


def running_totals(
    counts: DataFrame, value: str, sums: Sequence[str], width: float | None = 1.0, before: bool = False
) -> DataFrame:
    """One row per distinct `value` with, for each column in `sums`, its total (same name) and
    `<name>_upto`, the running total over values up to and including this one.

    Running totals are kept per chunk and shifted by the totals of smaller chunks, so the ordered
    window without a partition sees one row per chunk.  A chunk is as wide as `width`, for values
    spread evenly enough; without a width the distinct values are written in ranges of about
    `RANGE_ROWS` each, wherever they crowd.  `before` adds `<name>_before`, the total at the next smaller
    value (null at the smallest).
    """
    totals = (
        counts.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    if width is None:
        totals = _in_ranges(totals, value)
    else:
        totals = totals.withColumn("chunk", F.floor(F.col(value) / F.lit(width)))
    within = W.partitionBy("chunk").orderBy(value)
    upto = within.rowsBetween(W.unboundedPreceding, 0)
    smaller = W.orderBy("chunk")
    earlier = smaller.rowsBetween(W.unboundedPreceding, -1)
    last = F.max_by(F.struct(*sums), value)
    shifts = (
        totals.groupBy("chunk")
        .agg(*[F.sum(c).alias(f"{c}_chunk") for c in sums], last.alias("last"))
        .select(
            "chunk",
            F.lag("last").over(smaller).alias("border"),
            *[
                F.coalesce(F.sum(f"{c}_chunk").over(earlier), F.lit(0)).alias(f"{c}_shift")
                for c in sums
            ],
        )
    )
    columns = {f"{c}_within": F.sum(c).over(upto) for c in sums}
    if before:
        columns |= {f"{c}_lag": F.lag(c).over(within) for c in sums}
    running = totals.withColumns(columns).join(shifts, "chunk")
    return running.select(
        value,
        *sums,
        *[(F.col(f"{c}_shift") + F.col(f"{c}_within")).alias(f"{c}_upto") for c in sums],
        *[F.coalesce(f"{c}_lag", f"border.{c}").alias(f"{c}_before") for c in sums if before],
    )


def _in_ranges(totals: DataFrame, value: str) -> DataFrame:
    """The rows, written, with the number of their range as `chunk`; chunks ascend with the value.

    The ranges are drawn once: drawn again, they might differ.
    """
    stored = materialize(totals, "distinct_values")
    parts = max(1, -(-stored.count() // RANGE_ROWS))
    ranged = stored.repartitionByRange(parts, value).withColumn("chunk", F.spark_partition_id())
    return materialize(ranged, "value_ranges")


def mid_ranks(counts: DataFrame, value: str, width: float | None = 1.0) -> DataFrame:
    """(value, n, mid_rank) over a frame of counts `n`, ties sharing the mean of their ranks."""
    n, upto = F.col("n"), F.col("n_upto")
    return running_totals(counts, value, ["n"], width).select(
        value, "n", (upto - n + (n + 1) / 2).alias("mid_rank")
    )


def rank_sums(counts: DataFrame, value: str, group: str, width: float | None = 1.0) -> DataFrame:
    """(group, n, rank_sum) from counts `n` per (group, value)."""
    ranks = mid_ranks(counts, value, width).select(value, "mid_rank")
    return (
        counts.join(ranks, value)
        .groupBy(group)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("mid_rank")).alias("rank_sum"),
        )
    )


def tie_term(counts: DataFrame, value: str) -> DataFrame:
    """One row: sum over distinct values of t^3 - t, and the number of rows."""
    t = F.col("t").cast("double")
    return (
        counts.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.sum("n").alias("t"))
        .agg(F.sum(t * t * t - t).alias("tie_term"), F.sum("t").alias("total"))
    )
