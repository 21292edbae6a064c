"""Helpers shared by the operators: tables, the shared folder, worker state."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, ship_package

T = TypeVar("T")

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/wardlake-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, **options: Any) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: its
    lineage is cut, it is computed once, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    return spark


def worker_state(name: str, make: Callable[[], T], large: bool = False) -> T:
    """A value that lives as long as the Python worker, over its tasks; a ``large`` one until a pass that does not use it.

    Task functions are pickled by value, so a module-level variable would be
    new in each task; ``sys`` is the one module every task shares."""
    kept = sys.__dict__.setdefault("_wardlake_worker_state", {})
    if name not in kept:
        kept[name] = make()
        if large:
            kept.setdefault("large", set()).add(name)
    return kept[name]


def release(uses: str | None = None) -> None:
    """Drop the worker's large values but those whose name begins with ``uses``, and give free memory back to the system,
    so that a worker does not carry one operator's peak into the next one's tasks."""
    kept = sys.__dict__.setdefault("_wardlake_worker_state", {})
    for name in [x for x in kept.get("large", ()) if uses is None or not x.startswith(uses)]:
        kept["large"].discard(name)
        kept.pop(name)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):                # another C library
        pass


def slices(batches: Iterator[Any], rows: int = 500, uses: str | None = None) -> Iterator[Any]:
    """Arrow batches cut into at most ``rows`` rows, so that few texts at a time become Python strings. ``uses``: the large
    worker values of this pass."""
    release(uses)
    try:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield batch.slice(lo, rows)
    finally:
        release(uses)


def blocks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive texts of about ``most`` characters; a text is never cut."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
