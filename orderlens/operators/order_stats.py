"""Exact positions and tiles of a global order without a global sort.

A window ordered over a whole table runs in one task.  Here only the rows standing at the
wanted positions are located: sampled pivots bracket each position, one counting pass proves
which bracket holds it, and the narrowing repeats until a bracket is small enough to number.
The sample only steers the search; the rows returned are exact.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.sources.scratch import materialize

# A bracket of this many rows is numbered inside one task.
BRACKET_ROWS = 200_000
# Keys brought to the driver per bracket and pass.
SAMPLE_ROWS = 4_000
MAX_PASSES = 40


@dataclass
class _Bracket:
    order: int
    position: int  # wanted 1-based position in the whole order
    low: Row | None  # inclusive
    high: Row | None  # exclusive
    below: int  # rows ordered before `low`
    size: int


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    positions: Sequence[int],
    total: int,
    bracket_rows: int = BRACKET_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> list[Row]:
    """The key rows at `positions` (1-based, within `total`) of `df` ordered by `keys` ascending.

    `keys` must identify a row.  Nulls order first.
    """
    order = F.struct(*keys)
    wanted = [(0, p, total) for p in positions]
    found = _located(df, [order], wanted, bracket_rows, sample_rows)
    return [found[0, p] for p in positions]


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    bracket_rows: int = BRACKET_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[str, float]:
    """Medians of unbounded numeric columns over their non-null values; `keys` identify a row.

    The built-in median keeps every distinct value in one aggregation buffer.  Here the two middle
    rows of each column are located instead, all columns in the same passes over the rows.  A column
    without values has no median.
    """
    if not columns:
        return {}
    sizes = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    orders = [
        F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("value"), *keys)) for c in columns
    ]
    wanted = [
        (i, middle, sizes[i])
        for i in range(len(columns))
        if sizes[i]
        for middle in sorted({(sizes[i] + 1) // 2, sizes[i] // 2 + 1})
    ]
    found = _located(df, orders, wanted, bracket_rows, sample_rows)
    middles: dict[str, list[float]] = {}
    for (i, _), row in found.items():
        middles.setdefault(columns[i], []).append(row[0])
    return {c: sum(values) / len(values) for c, values in middles.items()}


def _located(
    df: DataFrame, orders: Sequence[Column], wanted: Sequence[tuple[int, int, int]], bracket_rows: int, sample_rows: int
) -> dict[tuple[int, int], Row]:
    """The rows at the wanted (order, position, rows of that order), by (order, position).

    `orders` are structs of one type that identify a row, or null where a row takes no part.  Every
    pass samples and counts for all of them at once.
    """
    if not wanted:
        return {}
    names = [f"k{i}" for i in range(len(orders))]
    keyed = df.select(*[order.alias(name) for order, name in zip(orders, names, strict=True)])
    fields = keyed.schema["k0"].dataType.fields

    def literal(row: Row) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])

    def inside(b: _Bracket) -> Column:
        k = F.col(names[b.order])
        test = k.isNotNull()
        if b.low is not None:
            test = test & (k >= literal(b.low))
        if b.high is not None:
            test = test & (k < literal(b.high))
        return test

    def span(b: _Bracket) -> tuple:
        return (b.order, b.low, b.high, b.below)

    def members(brackets: list[_Bracket], chance: Column | None = None) -> DataFrame:
        """(span, k) of the rows in each of the brackets, or of some of them."""
        rows = [
            F.when(inside(b) if chance is None else inside(b) & (chance < sample_rows / b.size),
                   F.struct(F.lit(i).alias("span"), F.col(names[b.order]).alias("k")))
            for i, b in enumerate(brackets)
        ]
        source = keyed if chance is None else keyed.withColumn("chance", chance)
        return source.select(F.inline(F.array_compact(F.array(*rows))))

    brackets = [_Bracket(order, p, None, None, 0, total) for order, p, total in wanted]
    for attempt in range(MAX_PASSES):
        wide = {span(b): b for b in brackets if b.size > bracket_rows}
        if not wide:
            break
        spans = list(wide)
        drawn = members(list(wide.values()), F.rand(attempt)).orderBy("span", "k").collect()
        samples: dict[tuple, list[Row]] = {}
        for r in drawn:
            samples.setdefault(spans[r["span"]], []).append(r["k"])
        pivots: list[tuple[_Bracket, Row, Row]] = []
        for b in brackets:
            sample = samples.get(span(b))
            if b.size <= bracket_rows or not sample:
                continue
            middle = (b.position - b.below) * len(sample) // b.size
            reach = 2 * math.isqrt(len(sample)) + 1
            pivots.append(
                (b, sample[max(middle - reach, 0)], sample[min(middle + reach, len(sample) - 1)])
            )
        if not pivots:
            continue
        counts = keyed.agg(
            *[
                F.count_if(inside(b) & (F.col(names[b.order]) < literal(cut))).alias(f"c{i}_{j}")
                for i, (b, low, high) in enumerate(pivots)
                for j, cut in enumerate((low, high))
            ]
        ).first()
        for i, (b, low, high) in enumerate(pivots):
            before_low, before_high = counts[f"c{i}_0"], counts[f"c{i}_1"]
            offset = b.position - b.below
            if offset <= before_low:
                b.high, b.size = low, before_low
            elif offset <= before_high:
                b.low, b.high = low, high
                b.below, b.size = b.below + before_low, before_high - before_low
            else:
                b.low, b.below, b.size = high, b.below + before_high, b.size - before_high

    if any(b.size > bracket_rows for b in brackets):
        raise RuntimeError(f"positions not narrowed to {bracket_rows} rows in {MAX_PASSES} passes")
    last = {span(b): b for b in brackets}
    spans = list(last)
    numbered = members(list(last.values())).withColumn("at", F.row_number().over(W.partitionBy("span").orderBy("k")))
    places = {(b.order, b.position): (spans.index(span(b)), b.position - b.below) for b in brackets}
    test = reduce(
        lambda x, y: x | y,
        [(F.col("span") == s) & (F.col("at") == a) for s, a in places.values()],
    )
    found = {(r["span"], r["at"]): r["k"] for r in numbered.where(test).collect()}
    return {key: found[place] for key, place in places.items()}


def tile_starts(total: int, tiles: int) -> list[int]:
    """First position of tiles 2..n under the SQL rule: the first `total % n` tiles get one more."""
    base, extra = divmod(total, tiles)
    starts = [j * base + min(j, extra) + 1 for j in range(1, tiles)]
    return [s for s in starts if s <= total]


def with_tiles(
    df: DataFrame,
    tiles: Mapping[str, tuple[int, Sequence[str]]],
    name: str,
    bracket_rows: int = BRACKET_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Add NTILE columns: `tiles` maps a new column to (number of tiles, ascending unique keys).

    The frame is written once; tiles are then literal comparisons against the exact cut keys,
    so the rows themselves are neither sorted nor shuffled.
    """
    stored = materialize(df, name)
    total = stored.count()
    columns = {}
    for column, (n, keys) in tiles.items():
        fields = [stored.schema[key] for key in keys]
        starts = tile_starts(total, n)
        cuts = (
            order_statistics(stored, keys, starts, total, bracket_rows, sample_rows)
            if starts
            else []
        )
        tile = F.lit(1)
        for cut in cuts:
            bound = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, fields)])
            tile = tile + (F.struct(*keys) >= bound).cast("int")
        columns[column] = tile
    return stored.withColumns(columns)
