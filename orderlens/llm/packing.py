"""Packing of examples into sequences as vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces of examples) and loss-bearing tokens.
Sizes are taken as shares of the limits.  An open sequence always receives the waiting example
whose size vector has the largest dot product with what the sequence has left, among those that
fit: it prefers examples that use the resources still plentiful.  When none fits and cutting is
allowed, the head of the best one fills the sequence and its rest goes on waiting.

Each task packs the examples of its own partition, a window at a time, and hands the open sequence
on to the next window: nothing is shuffled, memory is bounded by the window, and at most one
sequence of a task ends short of tokens (others only where the other limits bind).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.llm import bpe
from orderlens.llm.workers import released


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


class Example(NamedTuple):
    """`bearing[k]` counts the loss-bearing ids among the first k; None: every id but the last."""

    key: object
    ids: np.ndarray
    bearing: np.ndarray | None = None

    def loss(self, start: int, end: int) -> int:
        if self.bearing is None:
            last = len(self.ids) - 1
            return min(end, last) - min(start, last)
        return int(self.bearing[end] - self.bearing[start])

    def reach(self, start: int, tokens: int, loss: int) -> int:
        """The furthest end of a piece from `start` within both limits."""
        if self.bearing is None:
            last = len(self.ids) - 1
            end = min(len(self.ids), start + tokens)
            return end if min(end, last) - min(start, last) <= loss else start + loss
        most = int(np.searchsorted(self.bearing, self.bearing[start] + loss, side="right")) - 1
        return min(len(self.ids), start + tokens, most)


class Piece(NamedTuple):
    example: Example
    start: int
    length: int
    sequence: int
    offset: int


class Packer:
    """Places windows of examples; sequences are numbered from `first` on."""

    def __init__(self, limits: Limits, cut: bool = True, first: int = 0):
        self.limits = limits
        self.cut = cut
        self.free = first
        self._open()

    def _open(self) -> None:
        """Start the next sequence."""
        self.sequence = self.free
        self.free += 1
        self.left = np.array(self.limits, np.int64)

    def _put(self, example: Example, start: int, end: int) -> Piece:
        piece = Piece(example, start, end - start, self.sequence, self.limits.tokens - int(self.left[0]))
        self.left -= (end - start, 1, example.loss(start, end))
        return piece

    def place(self, examples: Iterable[Example]) -> Iterator[Piece]:
        """Pieces of all examples; each id is in exactly one.  Without cutting, an example beyond
        the limits is an error, since it fits nowhere.  An example without ids has no piece."""
        waiting: list[tuple[Example, int]] = []
        sizes = []
        for example in examples:
            start = 0
            while self.cut and len(example.ids) - start >= self.limits.tokens:
                end = example.reach(start, self.limits.tokens, self.limits.loss)
                if end == start:
                    raise ValueError("the limit of loss-bearing tokens leaves no room for a token")
                if end - start < self.limits.tokens:
                    break
                yield Piece(example, start, end - start, self.free, 0)  # a sequence of its own
                self.free += 1
                start = end
            if start < len(example.ids):
                loss = example.loss(start, len(example.ids))
                if not self.cut and (len(example.ids) > self.limits.tokens or loss > self.limits.loss):
                    raise ValueError(f"example {example.key} does not fit into a sequence")
                waiting.append((example, start))
                sizes.append((len(example.ids) - start, 1, loss))
        need = np.array(sizes, np.int64).reshape(-1, 3)
        share = need / np.array(self.limits)
        active = np.ones(len(need), bool)
        remaining = len(need)
        while remaining:
            fits = active & (need <= self.left).all(1)
            usable = fits if fits.any() else active
            score = np.where(usable, share @ (self.left / np.array(self.limits)), -1.0)
            best = int(np.argmax(score))
            example, start = waiting[best]
            if fits[best]:
                yield self._put(example, start, len(example.ids))
                active[best] = False
                remaining -= 1
            else:
                end = start
                if self.cut and self.left[1] > 0:
                    end = example.reach(start, int(self.left[0]), int(self.left[2]))
                if end > start:
                    yield self._put(example, start, end)
                    waiting[best] = (example, end)
                    need[best] = (len(example.ids) - end, 1, example.loss(end, len(example.ids)))
                    share[best] = need[best] / np.array(self.limits)
                self._open()
            if not self.left[0]:
                self._open()


# What `packed` returns of each piece besides its place: columns and how ids become their values.
Projection = tuple[str, Callable[[np.ndarray], tuple]]
WHOLE: Projection = ("ids array<int>", lambda ids: (ids.astype(np.int32),))
CHECKSUM: Projection = ("ids_crc32 long", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))

PLACES = "start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def packed(
    df: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    limits: Limits = Limits(),
    projection: Projection = WHOLE,
) -> DataFrame:
    """Pieces of every text's ids, each with its sequence and offset.

    A text is followed by `end_id`, so a null or empty text is that id alone; every id bears loss
    but the end.  Repeated rows are packed each, with null keys too; an empty table has no pieces;
    other columns are not read.  Sequence numbers differ between tasks by their upper half.
    """
    encode = lambda batch: _tokenized(batch, path, end_id)
    return _packed(df.select(id_column, bpe.text_or_empty(text)), encode, limits, True, projection)


def packed_examples(
    df: DataFrame, id_column: str, ids: str, bearing: str, limits: Limits = Limits(), projection: Projection = WHOLE
) -> DataFrame:
    """The same for ready examples of instruction data, which stay whole.

    `ids` is an array of token ids, `bearing` one of flags that say which bear loss; null arrays
    count as empty, null flags as false, missing flags as false.  Examples without ids have no
    piece; one beyond the limits ends the job with an error that names it.
    """
    columns = [
        F.coalesce(F.col(c).cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>")).alias(name)
        for c, kind, name in ((ids, "int", "ids"), (bearing, "boolean", "bearing"))
    ]
    return _packed(df.select(id_column, *columns), _ready, limits, False, projection)


def _tokenized(batch: pa.RecordBatch, path: str, end_id: int) -> Iterator[tuple[pa.Scalar, list[Example]]]:
    encoder, _ = bpe.segment_tree_encoder(path)
    end = np.array([end_id], np.uint32)
    for keys, texts in bpe.small_batches(batch):
        yield [Example(k, np.concatenate([x, end])) for k, x in zip(keys, encoder.texts(texts), strict=True)]


def _ready(batch: pa.RecordBatch) -> Iterator[list[Example]]:
    made = []
    for key, ids, flags in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        flags = [bool(f) for f in flags[: len(ids)]] + [False] * max(0, len(ids) - len(flags))
        made.append(Example(key, np.array(ids, np.uint32), np.append(0, np.cumsum(np.array(flags, np.int64)))))
    yield made


def _packed(df: DataFrame, examples, limits: Limits, cut: bool, projection: Projection) -> DataFrame:
    columns, project = projection
    fields = T._parse_datatype_string(f"{PLACES}, {columns}").fields
    schema = T.StructType([df.schema[0], *fields])
    types = to_arrow_schema(schema)

    def work(batches):
        packer = Packer(limits, cut, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for window in examples(batch):
                rows = [
                    (
                        p.example.key.as_py(), p.start, p.length, len(p.example.ids), p.sequence, p.offset,
                        p.example.loss(p.start, p.start + p.length),
                        *project(p.example.ids[p.start : p.start + p.length]),
                    )
                    for p in packer.place(window)
                ]
                if rows:
                    values = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types.types, strict=True)]
                    yield pa.RecordBatch.from_arrays(values, schema=types)

    return df.mapInArrow(released(work), schema)
