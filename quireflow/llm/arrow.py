"""Bounded slices of Arrow batches for the operators that work in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def give_back() -> None:
    """Freed memory goes back to the system; else a worker keeps the most that any task before took, for as long as it lives."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most `limit` bytes of `column`; a longer single text is a slice of its own. Between batches, freed memory is given back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to
        del batch
        give_back()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's strings in UTF-8; null is the empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def whole_keys(docs: DataFrame, key: str) -> str:
    """The type of a key column of whole numbers; other types raise, as they can't be cast without loss."""
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"keys must be whole numbers, {key} is {kind}")
    return kind
