"""Counts, rates, tops and volume of a log table (or of any part of one)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed_values as fv
from logloom.functions.normalize import is_error, text_or_null, truncate
from logloom.schema import count_with_first

LEVEL_COLUMNS = ["INFO", "WARN", "ERROR", "DEBUG", "OTHER"]


def total_logs(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("total_logs"))


def level_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("n"))


def _rate(errors: Column, total: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(errors * 100.0, total), 2), F.lit(0.0))


def rate_columns() -> list[Column]:
    errors, total = F.count_if(is_error(F.col("level"))), F.count("*")
    return [total.alias("total"), errors.alias("errors"), _rate(errors, total).alias("error_rate")]


def error_rate(logs: DataFrame) -> DataFrame:
    return logs.agg(*rate_columns())


def top_services(logs: DataFrame, n: int = 10) -> DataFrame:
    """Busiest services with their share of all rows, first seen on ties."""
    name = F.coalesce(text_or_null(F.col("service")), F.lit("unspecified")).alias("service")
    counts = count_with_first(logs.select(name, "source", "line_number"), "service")
    total = total_logs(logs).scalar()  # reads no column
    top = counts.orderBy(F.desc("n"), "first_ord", "service").limit(n)
    return top.select("service", F.col("n").alias("count"), F.round(F.col("n") * 100.0 / total, 1).alias("percentage"))


def top_errors(logs: DataFrame, n: int = 10, width: int = 150) -> DataFrame:
    """Most frequent beginnings of error messages, first seen on ties."""
    text = truncate(F.coalesce("message", F.lit("")), width).alias("message")
    errors = logs.where(is_error(F.col("level"))).select(text, "source", "line_number")
    counts = count_with_first(errors, "message")
    return counts.orderBy(F.desc("n"), "first_ord", "message").limit(n).select("message", F.col("n").alias("count"))


def time_range(logs: DataFrame) -> DataFrame:
    """First and last time with their timestamps, and the seconds between."""
    bounds = logs.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"), F.min("ts").alias("ts_lo"), F.max("ts").alias("ts_hi"))
    return bounds.select(
        F.col("lo").alias("start_epoch"),
        F.col("hi").alias("end_epoch"),
        F.col("ts_lo").alias("start_ts"),
        F.col("ts_hi").alias("end_ts"),
        F.coalesce(F.round(F.col("hi") - F.col("lo"), 1), F.lit(0.0)).alias("duration_seconds"),
    )


def _level_column(level: Column) -> Column:
    known = [c for c in LEVEL_COLUMNS if c != "OTHER"]
    return F.when(level.isin(known), level).when(level == "CRITICAL", "ERROR").otherwise("OTHER")


def count_levels() -> list[Column]:
    """Row count and one count per histogram level column."""
    kind = _level_column(F.coalesce("level", F.lit("INFO")))
    return [F.count("*").alias("total"), *[F.count_if(kind == c).alias(c) for c in LEVEL_COLUMNS]]


def volume_histogram(logs: DataFrame, buckets: int = fv.HISTOGRAM_BUCKETS) -> DataFrame:
    """Rows per level in ``buckets + 1`` equal steps from first to last time.

    Steps without rows are kept. Two narrow scans: the time bounds, then the
    counts, which are combined before their shuffle.
    """
    dated = logs.where(F.col("epoch").isNotNull()).select("epoch", "level")
    span = dated.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi"))
    width = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo")) / buckets)
    step = span.select(F.struct("lo", width.alias("width")))
    index = F.least(F.floor((F.col("epoch") - F.col("step.lo")) / F.col("step.width")), F.lit(buckets))
    counted = dated.withColumn("step", step.scalar()).groupBy(index.alias("bucket")).agg(*count_levels())
    every = logs.sparkSession.range(buckets + 1).select(F.col("id").alias("bucket"), step.scalar().alias("step"))
    every = every.where(F.col("step.lo").isNotNull()).select(
        "bucket", (F.col("step.lo") + F.col("bucket") * F.col("step.width")).alias("start_epoch")
    )
    return every.join(F.broadcast(counted), "bucket", "left").fillna(0, ["total", *LEVEL_COLUMNS])


def affected_services(logs: DataFrame) -> DataFrame:
    named = text_or_null(F.col("service")).isNotNull()
    return logs.where(is_error(F.col("level")) & named).select("service").distinct()


def kpi_summary(logs: DataFrame, times: bool = False) -> DataFrame:
    """Headline numbers in one row; with ``times``, also the first and last time."""
    per_service = logs.groupBy(F.coalesce(text_or_null(F.col("service")), F.lit("unspecified")).alias("service")).agg(
        F.count("*").alias("n"),
        F.count_if(is_error(F.col("level"))).alias("errors"),
        F.min("epoch").alias("lo"),
        F.max("epoch").alias("hi"),
        F.min("ts").alias("ts_lo"),
        F.max("ts").alias("ts_hi"),
    )
    bounds = [F.min("ts_lo").alias("start_ts"), F.max("ts_hi").alias("end_ts")] if times else []
    total, errors = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("errors"), F.lit(0))
    return per_service.agg(
        total.alias("total_logs"),
        errors.alias("errors"),
        _rate(errors, total).alias("error_rate"),
        F.count("*").alias("services"),
        *bounds,
        F.coalesce(F.round(F.max("hi") - F.min("lo"), 1), F.lit(0.0)).alias("duration_seconds"),
    )


def compute_metrics(logs: DataFrame) -> dict[str, DataFrame]:
    """Every metric of a log table, lazily."""
    return {
        "total_logs": total_logs(logs),
        "level_counts": level_counts(logs),
        "error_rate": error_rate(logs),
        "services": top_services(logs),
        "top_errors": top_errors(logs),
        "histogram": volume_histogram(logs),
        "time_range": time_range(logs),
    }
