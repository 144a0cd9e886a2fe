"""Vector columns as packed doubles, and block keys for work on pairs of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.sources.scratch import materialize


def usable(vector: str) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def packed(df: DataFrame, vec_id: str, vector: str, scale: float | None = None) -> DataFrame:
    """`vec_id long` and `packed`, the components as binary doubles, written once.

    With `scale`, components become floor(scale * x).  Unusable vectors and rows without an id are
    left out; of rows that share an id the one with the smallest packed form counts.
    """

    def work(batches):
        for batch in batches:
            values = batch.column(1)
            flat = np.asarray(values.flatten(), dtype=np.float64)
            if scale is not None:
                flat = np.floor(scale * flat) + 0.0  # no negative zero
            sizes = values.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            raw = [flat[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "packed"])

    chosen = df.where(F.col(vec_id).isNotNull() & usable(vector))
    wide = chosen.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = wide.mapInArrow(work, "vec_id long, packed binary")
    return materialize(rows.groupBy("vec_id").agg(F.min("packed").alias("packed")), "vectors")


def blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def block_of(vec_id: str, n: int | Column, salt: str) -> Column:
    """A block from 0 to n - 1 by a hash of the id."""
    return F.pmod(F.xxhash64(vec_id, F.lit(salt)), F.lit(n) if isinstance(n, int) else n).cast("int")


def every(n: int | Column) -> Column:
    """All block numbers."""
    return F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1))


def unpack(column) -> np.ndarray:
    """Rows of one length as a matrix."""
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)
