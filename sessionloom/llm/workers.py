"""Small helpers for code that runs inside Python workers."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

STORE = "_sessionloom_worker_store"
SLICE_BYTES = 4 << 20


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """One ``make()`` per worker process and key, kept while the worker is reused.

    Functions reach the workers by value, with globals of their own in each task;
    what is costly to build therefore lives in a module entry of the process.
    """
    store = sys.modules.setdefault(STORE, types.ModuleType(STORE)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give the system back what earlier tasks of this reused worker have freed."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``limit`` bytes of text, or one longer row."""
    release()
    for batch in batches:
        yield from cuts(batch, limit, column)


def cuts(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The pieces of one batch, as ``slices`` cuts it."""
    sizes = pa.compute.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False) + 64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[field.name], field.type) for field in schema], schema=schema
    )
