"""Log lines from text files, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.workspace import broadcast_if_small, settle, stored


def _placed(df: DataFrame, source_as: str) -> DataFrame:
    source = {"path": "_metadata.file_path", "name": "_metadata.file_name"}[source_as]
    return df.select(
        F.col(source).alias("source"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def number_lines(placed: DataFrame, decode: bool = False) -> DataFrame:
    """Give each line its 1-based number in its file, without shuffling lines.

    The text is read once, into a table in the shared folder. A file split is
    read in order by one task, so a line's place in its split is its row id
    less the split's first one. The split sizes are a small table: one row per
    split, added up per file. Both come from the stored rows, so they agree
    however the files were cut. ``decode`` is :func:`decode_lines`, from a
    flag that was stored with each line.
    """
    rows = placed.withColumn("row_id", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("valid", F.is_valid_utf8("line")), "lines")
    splits = rows.groupBy("path", "block").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n"))
    before = "sum(n) over (partition by path order by block rows between unbounded preceding and 1 preceding)"
    splits = settle(splits.select("path", "block", "first_id", F.coalesce(F.expr(before), F.lit(0)).alias("before")))
    lines = rows.join(broadcast_if_small(splits), ["path", "block"]).select(
        "source", (F.col("before") + F.col("row_id") - F.col("first_id") + 1).alias("line_number"), "line"
    )
    return _as_latin1(lines, rows.where("NOT valid")) if decode else lines


def number_whole(placed: DataFrame) -> DataFrame:
    """As :func:`number_lines`, for files that are not cut: each is read in
    order by one task, which numbers the lines as they pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in filter(len, batches):
            path = batch["path"].dictionary_encode()
            starts = np.flatnonzero(np.diff(path.indices.to_numpy(), prepend=-1))
            ends = np.append(starts[1:], len(batch))
            number = np.arange(1, len(batch) + 1, dtype=np.int64) - np.repeat(starts, ends - starts)
            if batch["path"][0] == last:
                number[: ends[0]] += n
            last, n = batch["path"][-1], number[-1]
            yield pa.RecordBatch.from_arrays([batch["source"], pa.array(number), batch["line"]], ["source", "line_number", "line"])

    return placed.select("source", "path", "line").mapInArrow(count, "source string, line_number long, line string")


def splits_of(batch: DataFrame) -> list[tuple[str, int]] | None:
    """(path, start) of each file split of a micro-batch, which is cut once for
    all its jobs; None if the frame is no micro-batch of files."""
    found = batch._jdf.queryExecution()
    if found.analyzed().getClass().getSimpleName() != "LogicalRDD":
        return None
    partitions = list(found.toRdd().partitions())
    if not all(p.getClass().getSimpleName() == "FilePartition" for p in partitions):
        return None
    return [(f.toPath().toString(), f.start()) for p in partitions for f in p.files()]


def number_batch(placed: DataFrame) -> DataFrame:
    """As :func:`number_lines`, for a micro-batch of :func:`read_log_stream`.

    Where no file is cut, nothing is stored or shuffled.
    """
    splits = splits_of(placed)
    cut = placed.agg(F.max("block")).first()[0] if splits is None else any(start for _, start in splits)
    return number_lines(placed) if cut else number_whole(placed)


def read_log_lines(
    spark: SparkSession, paths: str | list[str], source_as: str = "path", decode: bool = False
) -> DataFrame:
    """Lines of text files as (source, line_number, line).

    ``source`` is the file's path, or its bare name with ``source_as='name'``
    (then names must differ). Blank lines keep their numbers. Bytes that are
    no UTF-8 pass unchanged, unless ``decode`` asks for :func:`decode_lines`.
    """
    return number_lines(_placed(spark.read.text(paths), source_as), decode)


def decode_lines(lines: DataFrame) -> DataFrame:
    """Read a source as Latin-1 when any of its lines is not valid UTF-8."""
    return _as_latin1(lines, lines.where(~F.is_valid_utf8("line")))


def _as_latin1(lines: DataFrame, invalid: DataFrame) -> DataFrame:
    broken = settle(invalid.select("source").distinct())
    if broken.isEmpty():
        return lines
    marked = lines.join(broadcast_if_small(broken.withColumn("broken", F.lit(True))), "source", "left")
    latin1 = F.decode(F.col("line").cast("binary"), "ISO-8859-1")
    return marked.select("source", "line_number", F.when(F.col("broken"), latin1).otherwise(F.col("line")).alias("line"))


def require_lines(lines: DataFrame) -> DataFrame:
    """Refuse an empty input."""
    if lines.isEmpty():
        raise ValueError("the input holds no log lines")
    return lines


def read_log_stream(spark: SparkSession, path: str, source_as: str = "path", max_files: int = 1000) -> DataFrame:
    """Stream of lines from files that arrive in a folder.

    Gives (source, path, block, line); :func:`number_batch` numbers the lines
    of one micro-batch.
    """
    lines = _placed(spark.readStream.option("maxFilesPerTrigger", max_files).text(path), source_as)
    # Reads given files again as they are: the names are no patterns.
    lines.read_again = lambda files: _placed(spark.read.option("__globPaths__", "false").text(files), source_as)
    return lines
