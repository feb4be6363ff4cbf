"""What mapInArrow's functions share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def released(apply: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """apply, giving free memory back to the system when a task ends: Spark keeps more workers for later tasks than run at once."""

    def run(batches: Iterator) -> Iterator:
        yield from apply(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return run
