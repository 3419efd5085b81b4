"""Small helpers that the operators of this package share.

Rows travel to Python as Arrow batches. Operators take the columns they need
by name, so extra columns of the input never clash with theirs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logloom.sources.workspace import new_dir, shared_dir, stored

__all__ = ["as_bytes", "batched", "blocks", "doc_table", "give_back", "keeps", "new_dir", "only", "ranges", "shared_dir", "small_batches", "stored"]

# Bytes of text that a Python step works on at once.
BLOCK_BYTES = 1 << 20
# Bytes that a Python step gets at once after :func:`small_batches`.
BATCH_BYTES = 4 << 20


def doc_table(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, text string`` and the columns named; null text stays null."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *(docs[c] for c in more))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def ranges(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``most`` bytes, a longer text alone."""
    start = size = end = 0
    for n in sizes:
        if size and size + n > most:
            yield start, end
            start, size = end, 0
        size, end = size + n, end + 1
    if start < end:
        yield start, end


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    return ranges(map(len, texts), most)


def small_batches(spark: SparkSession) -> None:
    """From now on Python steps of the session get some ``BATCH_BYTES`` at
    once, or one longer row. Executor and worker hold several copies of what
    travels."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later. A worker
    lives through many stages beside others, each of which would keep its own
    peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_kept: list = []


def keeps(make: Callable) -> Callable:
    """Let a worker keep what ``make`` gives from task to task of the steps
    that use it."""
    cached = lru_cache(2)(make)
    _kept.append(cached)
    return cached


def only(*used: Callable) -> None:
    """Drop what steps before have kept in this worker, but for ``used``. A
    worker goes on to other steps, which would carry it to no use."""
    others = [f for f in _kept if f not in used and f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        give_back()


def batched(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, uses: tuple[Callable, ...] = ()) -> DataFrame:
    """Run ``work`` on each Arrow batch; it returns column name -> values.
    ``uses`` are functions of :func:`keeps` that it calls."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(*uses)
        for batch in batches:
            columns = work(batch)
            arrays = [v.cast(f.type) if isinstance(v := columns[f.name], pa.Array) else pa.array(v, f.type) for f in out]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)
            del columns, arrays, batch
            give_back()

    return df.mapInArrow(run, schema)
