"""Packing of whole texts into few sequences by minimum bin slack.

A sequence is filled at once: the longest waiting piece opens it, and a subset-sum table over the
lengths of the others says how full it can become.  The table is one integer whose bit s is set
where some of the lengths add up to s; a length joins it by a shift and an "or".  Lengths enter from
long to short, each as often as it is there and fits, and the table is finished early once the exact
room is reachable.  Walking back through its earlier states names the pieces, which leave the pool.

Each task keeps a pool of waiting pieces and fills a sequence whenever the pool is full, so short and
long pieces meet across the whole partition; nothing is shuffled, memory is bounded by the pool, and
only the last sequences of a task, when the pool runs dry, may end short.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orderlens.llm import bpe
from orderlens.llm.bpe import small_batches, text_or_empty

TOKENS = 2048
POOL = 4096  # waiting pieces of a task
# Beyond the Latin blocks, and the one letter there whose lower case is two characters.
_OTHER = re.compile("[^\x00-\u012f\u0131-\u017f]")


# ---- ids ----------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of whole texts under a vocabulary of lower-case words.

    Texts of Latin letters, digits and signs are cut into words here and merged by the trees of
    `bpe`, new words only; their lower case and composed forms are character by character.  Any other
    text goes to the `tokenizers` library as it is, which all ids are tested against.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = bpe.Vocabulary(path)
        self.special = list(vocabulary.special)

        def encode(flat, starts, sizes):
            space = (flat[starts] == 0x20) | ((flat[starts] >= 0x09) & (flat[starts] <= 0x0D))
            # The two white-space characters of two bytes.
            two = sizes > 1
            second = flat[starts + two]
            space |= two & (flat[starts] == 0xC2) & ((second == 0x85) | (second == 0xA0))
            return bpe.encode_pieces(flat, starts, np.where(space, 0, sizes), vocabulary)

        self.latin = bpe.Encoder(encode, {}, cut=bpe.word_starts)

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        latin = [not _OTHER.search(t) and not any(s in t for s in self.special) for t in texts]
        known = self.latin.texts([t.lower() for t, is_latin in zip(texts, latin, strict=True) if is_latin])
        for text, is_latin in zip(texts, latin, strict=True):
            yield next(known) if is_latin else self._asked(text)

    def _asked(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---- packing ------------------------------------------------------------------------------------


class Piece(NamedTuple):
    key: object
    number: int
    start: int
    length: int
    values: tuple


def fullest(available: Iterable[tuple[int, int]], room: int) -> list[int]:
    """The lengths, of those available as (length, how many), that fill `room` as far as possible.

    Lengths come from long to short; of equally full choices the one that needs the fewest short
    lengths is found first.
    """
    if room <= 0:
        return []
    reach, within = 1, (1 << room + 1) - 1
    states: list[tuple[int, int]] = []
    for length, count in available:
        for _ in range(min(count, room // length)):
            grown = (reach | reach << length) & within
            if grown == reach:
                break
            states.append((length, reach))
            reach = grown
            if reach >> room:
                break
        if reach >> room:
            break
    total = reach.bit_length() - 1
    chosen = []
    for length, before in reversed(states):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


class Pool:
    """Waiting pieces by length."""

    def __init__(self, tokens: int):
        self.tokens = tokens
        self.lengths: list[int] = []
        self.waiting: dict[int, deque[Piece]] = {}
        self.size = 0

    def add(self, piece: Piece) -> None:
        if piece.length not in self.waiting:
            self.waiting[piece.length] = deque()
            insort(self.lengths, piece.length)
        self.waiting[piece.length].append(piece)
        self.size += 1

    def _take(self, length: int) -> Piece:
        queue = self.waiting[length]
        piece = queue.popleft()
        self.size -= 1
        if not queue:
            del self.waiting[length]
            del self.lengths[bisect_right(self.lengths, length) - 1]
        return piece

    def filled(self) -> list[Piece]:
        """The pieces of the next sequence: the longest, and the fullest choice of others."""
        first = self._take(self.lengths[-1])
        room = self.tokens - first.length
        fitting = range(bisect_right(self.lengths, room) - 1, -1, -1)
        counted = ((self.lengths[i], len(self.waiting[self.lengths[i]])) for i in fitting)
        return [first, *(self._take(length) for length in fullest(counted, room))]


def place(pieces: Iterable[Piece], tokens: int = TOKENS, pool: int = POOL) -> Iterator[list[Piece]]:
    """The pieces of one sequence after another; every piece is in exactly one."""
    waiting = Pool(tokens)
    for piece in pieces:
        if piece.length == tokens:
            yield [piece]
            continue
        waiting.add(piece)
        while waiting.size >= pool:
            yield waiting.filled()
    while waiting.size:
        yield waiting.filled()


# ---- Spark --------------------------------------------------------------------------------------


# What `packed` returns of each piece besides its place: columns and how ids become their values.
Projection = tuple[str, Callable[[np.ndarray], tuple]]
WHOLE: Projection = ("ids array<int>", lambda ids: (ids.astype(np.int32),))
CHECKSUM: Projection = ("ids_crc32 long", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))


def packed(
    df: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    tokens: int = TOKENS,
    pool: int = POOL,
    projection: Projection = WHOLE,
) -> DataFrame:
    """Pieces of every text's ids, each with its sequence and its place there.

    Columns: the id, `piece int`, `start long`, `length long`, `sequence_id long`, `offset long` and
    those of `projection`.  A text is followed by `end_id`, so a null or empty text is that id alone.
    Only texts of more than `tokens` ids are cut, into pieces of `tokens` ids and a rest; a text of
    any length is encoded a part at a time.  Repeated rows are packed each, with null keys too; an
    empty table has no pieces; other columns are not read.  Sequence numbers differ between tasks by
    their upper half; pieces of equal length are placed in the order of the rows.
    """
    columns, project = projection
    fields = T._parse_datatype_string(f"piece int, start long, length long, sequence_id long, offset long, {columns}").fields
    rows = df.select(id_column, text_or_empty(text))
    schema = T.StructType([rows.schema[0], *fields])
    types = to_arrow_schema(schema)

    def pieces(batches) -> Iterator[Piece]:
        encoder = word_encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for keys, texts in small_batches(batch):
                for key, ids in zip(keys, encoder.texts(texts), strict=True):
                    ids = np.concatenate([ids, end])
                    for number, start in enumerate(range(0, len(ids), tokens)):
                        part = ids[start : start + tokens]
                        yield Piece(key.as_py(), number, start, len(part), project(part))

    def work(batches):
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        for together in place(pieces(batches), tokens, pool):
            offset = 0
            for p in together:
                rows.append((p.key, p.number, p.start, p.length, sequence, offset, *p.values))
                offset += p.length
            sequence += 1
            if len(rows) >= 2_000:
                yield _batch(rows, types)
                rows = []
        if rows:
            yield _batch(rows, types)

    return rows.mapInArrow(work, schema)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    values = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types.types, strict=True)]
    return pa.RecordBatch.from_arrays(values, schema=types)
