"""Which of very many hashes are frequent: counts by cell, gathered sparsely, kept as one bit each.

A cell is the upper bits of a hash.  Tasks hand on, for each part of the cells, the ascending cells
they met and how often, as differences packed into planes of bytes: little more than one byte for
each hash, whatever the number of cells.  Each part is summed on its own; what comes back is a bit
for each cell, so the table's size is set by its number of cells alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.workers import released

LEAST_BITS, MOST_BITS = 16, 28  # cells of a table; the largest takes 32 MB
PART_BITS = 20  # cells of a part
HELD = 2_000_000  # hashes a task gathers before it hands them on
MERGED = 256  # messages that are added up in one group


def bits_for(hashes: int, cells_each: int) -> int:
    """Bits of a table with some cells for each hash, within the bounds above."""
    return min(MOST_BITS, max(LEAST_BITS, int(cells_each * hashes).bit_length()))


def parts_for(bits: int) -> int:
    return 1 << max(0, bits - PART_BITS)


class Gatherer:
    """Collects hashes of a task; `add` and `rest` give messages (part, packed) to hand on."""

    def __init__(self, bits: int):
        self.bits = bits
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> list[tuple[int, bytes]]:
        self.held.append((hashes >> np.uint64(64 - self.bits)).astype(np.uint32))
        self.size += len(hashes)
        return self.rest() if self.size >= HELD else []

    def rest(self) -> list[tuple[int, bytes]]:
        if not self.size:
            return []
        cells, counts = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        inside = min(self.bits, PART_BITS)
        part, place = cells >> np.uint32(inside), cells & np.uint32((1 << inside) - 1)
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        return [
            (int(part[a]), packed(place[a:b], counts[a:b]))
            for a, b in zip(edges, np.append(edges[1:], len(part)), strict=True)
        ]


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places and their counts, differences first, byte by byte of equal weight."""
    steps = np.diff(places, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    times = np.minimum(counts, 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2)
    return zlib.compress(np.concatenate([steps.T.ravel(), times.T.ravel()]).tobytes(), 1)


def unpacked(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(message), np.uint8).reshape(6, -1)
    steps = np.ascontiguousarray(planes[:4].T).view("<u4").ravel()
    times = np.ascontiguousarray(planes[4:].T).view("<u2").ravel()
    return np.cumsum(steps, dtype=np.int64), times.astype(np.int64)


def frequent(messages: DataFrame, bits: int, least: int) -> np.ndarray:
    """Packed bits of the cells that occur at least `least` times in (part int, packed binary).

    Messages of a part are added up in groups of about `MERGED`, the sums once more; the driver gets
    the finished bits.
    """
    inside = 1 << min(bits, PART_BITS)

    def summed(rows: pd.DataFrame) -> np.ndarray:
        counts = np.zeros(inside, np.int64)
        for message in rows["packed"]:
            places, times = unpacked(message)
            counts[places] += times
        return counts

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        counts = summed(rows)
        places = np.flatnonzero(counts)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "packed": [packed(places.astype(np.uint32), counts[places])]})

    def flag(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [np.packbits(summed(rows) >= least, bitorder="little").tobytes()]})

    groups = F.pmod(F.xxhash64("packed"), F.lit(_groups(messages))).cast("int")
    merged = messages.groupBy("part", groups).applyInPandas(merge, "part int, packed binary")
    table = np.zeros(max(1, inside // 8) * parts_for(bits), np.uint8)
    size = max(1, inside // 8)
    for row in merged.groupBy("part").applyInPandas(flag, "part int, bits binary").toLocalIterator():
        table[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return table


def _groups(messages: DataFrame) -> int:
    """So many groups that none adds up many more than `MERGED` messages."""
    most = messages.groupBy("part").count().agg(F.max("count")).first()[0] or 1
    return -(-most // MERGED)


def contains(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


MESSAGE = "part int, packed binary"


def gathered(hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    """A function over batches that hands on the cells of the hashes found in each."""

    def work(batches):
        gatherer = Gatherer(bits)
        for batch in batches:
            for one in hashes(batch):
                yield from _messages(gatherer.add(one))
        yield from _messages(gatherer.rest())

    return released(work)


def present(hashes: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the cells of a column of 64-bit hashes (longs)."""
    column = lambda batch: iter([batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
    return frequent(hashes.mapInArrow(gathered(column, bits), MESSAGE), bits, 1)


def _messages(found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if found:
        columns = [pa.array([p for p, _ in found], pa.int32()), pa.array([m for _, m in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "packed"])
