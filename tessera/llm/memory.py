"""Batches in Python workers, and names of columns.

Workers are used again by later stages: what a task has freed goes back to the system when it ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tessera.session import ship

Batches = Iterator[pa.RecordBatch]


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, with its freed memory returned at the end of each task."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(columns: list[str], names: list[str]) -> list[str]:
    """Those of ``columns`` that have none of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package on the workers and freed memory returned after each task."""
    ship(df.sparkSession)
    return df.mapInArrow(released(run), schema)
