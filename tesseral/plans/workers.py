"""Memory of Python workers: what a task has freed goes back to the system.

Spark keeps a worker for the next task. Arrow's pool and the C library keep what a
task has freed, some 100 MB for each worker, for as long as it lives; so an executor's
memory adds up over the steps of a job, beside a heap that doesn't shrink either.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system; where the C library can't, only Arrow's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, that gives memory back when a task ends, however it ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def lean_groups(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow: memory goes back after each group."""

    def whole(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return whole


__all__ = ["give_back", "lean", "lean_groups"]
