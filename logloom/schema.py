"""The log table and its order.

Every row has a place ``(source, line_number)``; "first" anywhere in this
package means first in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = ("source", "line_number")

LINES_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("parser", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("epoch", T.DoubleType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("stack_trace", T.ArrayType(T.StringType())),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("host", T.StringType()),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()


def row_id() -> Column:
    """Row id that a retried task computes alike; null without a line number."""
    return F.when(F.col("line_number").isNotNull(), F.sha2(F.concat_ws(":", "source", F.col("line_number").cast("string")), 256))


def ord_struct(*names: str) -> Column:
    return F.struct(*(names or ORDER))


def count_with_first(df: DataFrame, *keys: str, **sums: Column) -> DataFrame:
    """Count rows per key and find the first place each key is seen.

    Counts and line numbers are fixed-width, so the row-level step is a hash
    aggregation with partial results before its shuffle; the place (a struct,
    which would force a sort-based one) is only built per (key, source).
    """
    per_source = df.groupBy(*keys, "source").agg(
        F.count("*").alias("n"),
        F.min("line_number").alias("line_number"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
    )
    return per_source.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min(ord_struct()).alias("first_ord"),
        *[F.sum(name).alias(name) for name in sums],
    )
