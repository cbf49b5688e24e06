"""Row identities and batches shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import scratch_path

ROW = "__row"


def with_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once with a unique ``__row``; rereads see the same numbers.

    ``monotonically_increasing_id`` may number a recomputed scan differently, a written
    table keeps its numbers whatever executors are lost. Repeated rows and null keys get
    identities of their own this way.
    """
    path = scratch_path(df.sparkSession, name)
    numbered = df.withColumn(ROW, F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def worker_store(name: str) -> dict:
    """A dict that outlives the task in its Python worker: loaded models and bounded caches.

    Functions shipped by value have fresh globals in every task, hence this place.
    """
    return sys.__dict__.setdefault("_pagesift_store", {}).setdefault(name, {})


def vacate(keep: str | None = None) -> None:
    """Drop what other operators keep in this Python worker, all but the store ``keep``, and give freed memory back.

    Workers live on from query to query: the encoders of one would else stand beside the tables of the next.
    """
    stores = sys.__dict__.get("_pagesift_store", {})
    left = [name for name in stores if name != keep]
    for name in left:
        del stores[name]
    if left:
        gc.collect()
    release()


def release() -> None:
    """Give freed memory back to the system; Arrow's allocator keeps that of the largest batches else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 256, chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so small that their texts (null: empty) stay in bounded memory."""
    for batch in batches:
        at, texts = 0, batch.column(column).to_pylist() if batch.num_rows <= rows else None
        sizes = pc.utf8_length(batch.column(column)).fill_null(0).to_pylist()
        while at < batch.num_rows:
            end, held = at, 0
            while end < batch.num_rows and end - at < rows and (end == at or held + sizes[end] <= chars):
                held += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            found = texts[at:end] if texts is not None else part.column(column).to_pylist()
            yield part, [t or "" for t in found]
            at = end
    batch = part = texts = found = None  # noqa: F841
    release()


BROADCAST_BYTES = 16 << 20


def small(table: DataFrame) -> bool:
    """Is a written table, by its files and the columns read, at most BROADCAST_BYTES large?"""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def keep_keys(big: DataFrame, keys: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows of ``big`` whose ``key`` is (or, with ``keep=False``, is not) in the written table ``keys``.

    A small table of keys is broadcast and ``big`` does not move; else both sides are
    shuffled. The rows are the same.
    """
    keys = keys.select(key)
    some = F.broadcast(keys.distinct()) if small(keys) else keys.distinct()
    return big.join(some, key, "left_semi" if keep else "left_anti")


def look_up(big: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of ``big`` with a written table, which is broadcast if it is small."""
    return big.join(F.broadcast(table) if small(table) else table, key)
