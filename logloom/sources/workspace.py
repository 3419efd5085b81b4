"""Shared scratch space and checks of size.

Intermediate tables go below ``spark.checkpoint.dir``, the folder all
executors share. It is set here only where the session has none.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The most that any broadcast of ours may hold.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 << 20

_made: list[str] = []
# Folders made inside :func:`temporary`, by thread: streams run their steps in threads.
_here = threading.local()


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = getattr(shared_dir, "local", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = shared_dir.local = tempfile.mkdtemp(prefix="logloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/logloom-{uuid.uuid4().hex}"
    _made.append(folder)
    if getattr(_here, "made", None) is not None:
        _here.made.append(folder)
    return f"{folder}/{name}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete the scratch folder that holds ``path``, one of :func:`new_dir`."""
    folder = path.rpartition("/")[0]
    _made.remove(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[str], str]]:
    """Delete what is stored inside at the end, but for paths given to the
    function that this yields. Frames that read the rest must be done by then."""
    outer, _here.made, kept = getattr(_here, "made", None), [], set()

    def keep(path: str) -> str:
        kept.add(path.rpartition("/")[0])
        return path

    try:
        yield keep
    finally:
        made, _here.made = _here.made, outer
        for folder in made:
            if folder in kept and outer is not None:
                outer.append(folder)
            elif folder not in kept and folder in _made:
                drop_dir(spark, f"{folder}/")


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders that this driver made. Frames that still
    read from them can't be used any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        folder = jvm.org.apache.hadoop.fs.Path(_made.pop())
        folder.getFileSystem(conf).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint: compute once, cut the lineage, survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str) -> str:
    """Write to a Parquet table in the shared folder; gives its path."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint after measuring rows and bytes; beyond the bounds Spark
    picks a shuffled join, whose skewed partitions it splits at run time.

    Only for settled or stored frames, since measuring runs a job. It stops
    counting past the bound, and a row counts its texts and 16 bytes a field.
    """
    few = df.limit(max_rows + 1)
    widths = [_width(f) for f in df.schema]
    size = few.select(reduce(add, widths).alias("bytes")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= max_rows and size["bytes"] <= max_bytes else df


def _width(field: T.StructField) -> Column:
    name = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16
    return F.lit(16)
