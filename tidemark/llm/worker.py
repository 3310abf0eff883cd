"""What a reused Python worker holds from one task to the next: the caches, of bounded size, of one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: What Python adds to a pair of a dictionary.
PAIR_BYTES = 200

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Freed memory goes back to the system; otherwise an idle worker keeps the peak of its last task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_HELD: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What an operator keeps in this worker until a task of another operator comes."""
    return _HELD.setdefault(operator, {})


def drop_others(operator: str) -> None:
    others = [name for name in _HELD if name != operator]
    for name in others:
        _HELD.pop(name).clear()
    if others:
        gc.collect()
        give_back()


def releasing(run: Run, keeps: str = "") -> Run:
    """``run``, dropping first what other operators hold, and giving memory back when its iterator ends, fails or is abandoned."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
