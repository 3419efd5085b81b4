"""Stored log tables and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.normalize import timestamp_text
from logloom.schema import ORDER

EXPORT_COLUMNS = ["Timestamp", "Level", "Service", "Message", "Source", "Line"]


def save_dataset(logs: DataFrame, path: str, mode: str = "error") -> None:
    """Store parsed logs as Parquet, one folder per day of ``ts``.

    The rebalance hint lets Spark split a day that holds much of the data and
    join small ones, so files come out of even size.
    """
    utc_day = F.to_date(F.to_utc_timestamp("ts", F.current_timezone()))
    logs.withColumn("day", utc_day).hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Logs as saved, plus ``day``; time filters prune the day folders."""
    return spark.read.parquet(path)


def list_datasets(logs: DataFrame) -> DataFrame:
    """Rows per dataset and format."""
    return logs.groupBy(F.col("source").alias("name"), "parser").agg(F.count("*").alias("log_count"))


def export_columns(logs: DataFrame) -> DataFrame:
    """The columns of a CSV export; absent values are empty."""
    empty = F.lit("")
    values: list[Column] = [
        F.coalesce(timestamp_text(F.col("ts"), F.col("ts_raw")), empty),
        F.coalesce("level", empty),
        F.coalesce("service", empty),
        F.coalesce("message", empty),
        F.coalesce("source", empty),
        F.coalesce(F.col("line_number").cast("string"), empty),
    ]
    return logs.select(*[v.alias(name) for v, name in zip(values, EXPORT_COLUMNS)])


def _in_order(logs: DataFrame, limit: int | None) -> DataFrame:
    ordered = logs.orderBy(*ORDER)
    return ordered if limit is None else ordered.limit(limit)


def write_csv(logs: DataFrame, path: str, limit: int | None = None, mode: str = "error") -> None:
    export = export_columns(_in_order(logs, limit))
    export.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(logs: DataFrame, path: str, limit: int | None = None, mode: str = "error") -> None:
    _in_order(logs, limit).write.mode(mode).option("ignoreNullFields", False).json(path)
