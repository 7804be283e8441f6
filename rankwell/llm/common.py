"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.sources.shared import cut, new_path, shared_dir

__all__ = ["BROADCAST_BYTES", "cut", "fits", "give_back", "join_small", "new_path", "shared_dir", "sole"]

#: Largest table, in bytes of payload, that an operator sends to every executor.
BROADCAST_BYTES = 32 << 20

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_OWNER: list[tuple[str | None, Callable[[], object] | None]] = [(None, None)]


def give_back() -> None:
    """A worker's freed memory goes back to the system, Arrow's and that of the C library."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def sole(owner: str, drop: Callable[[], object] | None = None) -> None:
    """A worker serves the stages of a pipeline in turn and keeps the state of one: when another owner's work begins, what `drop` of the last one drops goes."""
    if (last := _OWNER[0])[0] != owner:
        if last[1] is not None:
            last[1]()
        if last[0] is not None:
            give_back()
        _OWNER[0] = owner, drop


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fits(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, of the given payload size in bytes each, stay below the broadcast limit."""
    total = df.agg(F.sum(size + F.lit(32)).alias("b")).first()["b"]
    return (total or 0) <= limit


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, size: Column) -> DataFrame:
    """Broadcast `small` if its measured size allows, else leave Spark a shuffled join that AQE can split."""
    return big.join(F.broadcast(small) if fits(small, size) else small, on, how)
