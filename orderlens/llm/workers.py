"""Memory of Python workers, which serve many tasks in a row."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`work` for `mapInArrow`, which gives freed memory back to the system at the end of a task.

    A worker lives on between tasks; what the allocators keep would count against its executor
    while later stages run.
    """

    @wraps(work)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)

    return task
