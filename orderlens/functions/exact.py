"""Order-independent sums and the two rounding rules used by the reports.

Money and day counts carry two decimals.  Summing them as 64-bit hundredths makes every
total independent of row and partition order and stays on the primitive codegen path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hundredths(c: Column | str) -> Column:
    """A two-decimal double as a whole number of hundredths."""
    return F.rint(_col(c) * F.lit(100.0)).cast("long")


def from_hundredths(c: Column) -> Column:
    return c / F.lit(100.0)


def exact_sum(c: Column | str) -> Column:
    """Sum of a two-decimal column, exact; null when no value is present."""
    return from_hundredths(F.sum(hundredths(c)))


def exact_mean(c: Column | str) -> Column:
    """Mean of a two-decimal column from its exact sum; null when no value is present."""
    return F.try_divide(exact_sum(c), F.count(_col(c)))


def half_even(c: Column, digits: int = 2) -> Column:
    """Scale, round half to even, unscale: the rule of dataframe libraries built on numpy."""
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def half_up(c: Column, digits: int) -> Column:
    """Round half away from zero on the shortest decimal form: the rule of SQL reports."""
    return F.round(c, digits)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double; null instead of an error on an empty whole."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole)
