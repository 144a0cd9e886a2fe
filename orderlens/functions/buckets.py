"""Right-closed bucketing with the bounds and labels of each report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds (days, grams) and labels as the reports print them.
DELAY_BOUNDS = (-7, -3, 0, 3, 7, 14)
DELAY_LABELS = (
    "7+ days early",
    "3-7 days early",
    "0-3 days early",
    "1-3 days late",
    "3-7 days late",
    "7-14 days late",
    "14+ days late",
)
DELAY_CHART_LABELS = (
    "<-7d",
    "-7 to -3d",
    "-3 to 0d",
    "0-3d late",
    "3-7d late",
    "7-14d late",
    ">14d late",
)
DELAY_CLASS_BOUNDS = (-7, 0, 7, 14)
DELAY_CLASS_LABELS = ("7+ early", "On-time", "1-7d late", "7-14d late", "14+ late")
WEIGHT_BOUNDS = (500, 2000, 5000, 10000)
WEIGHT_LABELS = (
    "1: ≤500g (Light)",
    "2: 500g–2kg",
    "3: 2kg–5kg",
    "4: 5kg–10kg",
    "5: >10kg (Heavy)",
)


def bucket_order(value: Column, bounds: Sequence[float]) -> Column:
    """1-based index of the right-closed bucket holding `value`; null stays null."""
    index = F.lit(1)
    for bound in bounds:
        index = index + (value > F.lit(float(bound))).cast("int")
    return index


def bucket_label(order: Column, labels: Sequence[str]) -> Column:
    # `element_at` on an array of literals does not pass a null index on, hence the guard.
    label = F.element_at(F.array(*[F.lit(label) for label in labels]), order)
    return F.when(order.isNotNull(), label)


def magnitude(value: Column, steps: Sequence[tuple[float, str]], top: str) -> Column:
    """Verbal band: the first label whose upper limit exceeds |value|, else `top`."""
    band = None
    for limit, label in steps:
        test = F.abs(value) < F.lit(limit)
        band = F.when(test, label) if band is None else band.when(test, label)
    return F.when(value.isNotNull(), band.otherwise(top))
