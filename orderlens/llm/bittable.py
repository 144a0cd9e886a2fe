"""A table of bits by hash: tells, in fixed memory, which rows a set of hashes cannot contain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Packed flags by the upper `bits` bits of a column of hashes (longs), whatever their number.

    The driver gets at most one number for every 64 flags.
    """
    place = f"shiftrightunsigned({column}, {64 - bits})"
    rows = (
        df.groupBy(F.expr(f"cast(shiftright({place}, 6) as int)").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} & 63 as int))")).alias("flags"))
        .collect()
    )
    table = np.zeros((1 << bits) // 64, np.uint64)
    for r in rows:
        table[r["word"]] = np.uint64(r["flags"] & 0xFFFFFFFFFFFFFFFF)
    return table


def contains(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """False where a hash is certainly not in the set."""
    place = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
