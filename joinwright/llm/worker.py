"""What a Python worker keeps from one task to the next.

Spark uses its Python workers again for every later stage of a session, so a cache
that one operator fills stays beside all others, and freed memory stays with the
allocators.  ``tidy`` wraps the function given to ``mapInArrow``.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

_caches: dict[str, Callable] = {}


def cached(fn: Callable) -> Callable:
    """``fn`` with its last four results kept, until a task that does not name it begins."""
    _caches[fn.__name__] = found = functools.lru_cache(maxsize=4)(fn)
    return found


def trim() -> None:
    """Gives memory that nothing uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def tidy(run: Callable[[Iterator], Iterator], *keeps: str) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, with no caches but those named; memory that the task has freed goes when it ends."""

    def task(batches):
        for name, fn in _caches.items():
            if name not in keeps:
                fn.cache_clear()
        yield from run(batches)
        trim()

    return task
