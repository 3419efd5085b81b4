"""Folding continuation lines into the header line before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions import normalize as nz
from logloom.functions.capture import evaluate_once
from logloom.sources.workspace import broadcast_if_small, settle


def fold_lines(lines: DataFrame, header_regex: str, lines_per_chunk: int = 100_000) -> DataFrame:
    """One row per header with the lines that follow it, in order.

    Gives (source, line_number, line, _lines). A line before any header of
    its source is a row of its own.

    Sources are cut into chunks of lines, so that a huge one is no single
    task: a small table holds the first and last header of each chunk, lines
    ahead of a chunk's first header are sent to the chunk of the header they
    belong to, and each chunk is then folded by itself.
    """
    rows = lines.where(nz.strip(F.col("line")) != "")
    rows = evaluate_once(rows, "is_header", nz.strip(F.col("line")).rlike(header_regex))
    rows = rows.withColumn("chunk", F.floor(F.col("line_number") / lines_per_chunk))

    at_header = F.when(F.col("is_header"), F.col("line_number"))
    chunks = rows.groupBy("source", "chunk").agg(F.min(at_header).alias("first"), F.max(at_header).alias("last"))
    earlier = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("source", "chunk", "first", F.last("last", ignorenulls=True).over(earlier).alias("carried"))

    placed = rows.join(broadcast_if_small(settle(chunks)), ["source", "chunk"])
    head = F.col("first").isNull() | (F.col("line_number") < F.col("first"))
    home = F.when(head & F.col("carried").isNotNull(), F.floor(F.col("carried") / lines_per_chunk))
    placed = placed.select(
        "source",
        "line_number",
        "line",
        "is_header",
        F.coalesce(home, "chunk").alias("chunk"),
    )
    so_far = W.partitionBy("source", "chunk").orderBy("line_number").rowsBetween(W.unboundedPreceding, 0)
    owned = placed.withColumn(
        "owner", F.coalesce(F.max(F.when(F.col("is_header"), F.col("line_number"))).over(so_far), "line_number")
    )
    # Same keys as the window, so the lines are not shuffled again. The header
    # is the first of each list; a trace is one value of one row in any case.
    folded = owned.groupBy("source", "chunk", "owner").agg(
        F.sort_array(F.collect_list(F.struct("line_number", "line"))).alias("l"),
    )
    texts = F.col("l")["line"]
    return folded.select(
        "source",
        F.col("owner").alias("line_number"),
        F.get(texts, F.lit(0)).alias("line"),
        F.slice(texts, F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))).alias("_lines"),
    )
