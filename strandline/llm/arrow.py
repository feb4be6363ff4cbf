"""mapInArrow with Python values: 64-bit ids keep their type beside nulls."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are Python values at once, and rows or bytes of an output batch.
SLICE_ROWS, ROWS, BATCH_BYTES = 500, 20_000, 4 << 20
#: What a worker keeps for later tasks, by the module whose tasks use it.
KEPT: dict[str, dict] = {}


def let_go(owner: str) -> None:
    """Forget what this worker keeps for tasks of other modules."""
    for other in KEPT.keys() - {owner}:
        del KEPT[other]


def at_rest(apply: Callable[[Iterator], Iterator], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """apply, for mapInArrow or mapInPandas, that gives free memory back to the system when a task ends. owner: the module whose
    tasks these are, apply's own if not given; what the worker kept for others goes as a task begins.

    Spark keeps workers for later tasks, more than run at once; what Arrow and the C library hold back in each adds up.
    """
    owner = owner or apply.__module__

    def run(batches: Iterator) -> Iterator:
        let_go(owner)
        yield from apply(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_rows(df: DataFrame, make: Callable[[], Callable[[Iterator[tuple]], Iterable[tuple]]], schema: str) -> DataFrame:
    """Apply make() once a task: it returns a function from the task's rows (tuples) to rows of schema."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in target]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in slices(batches) for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out, size = [], 0
        for row in make()(given):
            out.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes))) + sum(4 * len(x) for x in row if hasattr(x, "shape"))
            if len(out) >= ROWS or size >= BATCH_BYTES:
                yield table(out)
                out, size = [], 0
        yield table(out)

    return df.mapInArrow(at_rest(apply, make.__module__), schema)
