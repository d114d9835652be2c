"""Memory that Python workers keep between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from . import words

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release_memory() -> None:
    """Give back what this worker has freed: allocators keep it, workers outlive tasks, and a long pipeline adds up."""
    words.forget_powers()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def released(task: Task) -> Task:
    """The task, which gives back freed memory at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run
