"""Memory of Python workers: a worker outlives its task, and what it keeps is missing in other stages."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def trim() -> None:
    """Gives memory that is no longer used back to the system: Arrow's pool and the C library keep it for later otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def trimming(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches, with ``trim`` when the task is through or given up."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            trim()

    return run
