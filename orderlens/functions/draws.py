"""Seeded draws that any engine with MD5 repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_draw(keys: Sequence[str], seed: int) -> Column:
    """A number below 2**60 from the keys and the seed: the first 15 hexadecimal digits of their MD5."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
