"""Filters, search, order and pages over a log table."""

from __future__ import annotations


import warnings

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed_values as fv
from logloom.functions.normalize import text_or_null
from logloom.schema import ORDER


def level_in(levels: list[str]) -> Column:
    return F.col("level").isin([name.upper() for name in levels])


def service_in(services: list[str]) -> Column:
    """Exact service names; ``unspecified`` finds rows without one."""
    named = F.coalesce(F.col("service").isin([s for s in services if s != "unspecified"]), F.lit(False))
    return named | text_or_null(F.col("service")).isNull() if "unspecified" in services else named


def time_between(
    start: float | None = None, end: float | None = None, keep_undated: bool = True, day: bool = False
) -> Column:
    """Epoch range, both ends included. Rows without a time pass unless told.

    ``day=True`` adds a predicate on the ``day`` folders of a stored dataset,
    so that Spark skips the folders outside the range.
    """
    undated, inside = F.col("epoch").isNull(), F.lit(True)
    for bound, keep in ((start, F.Column.__ge__), (end, F.Column.__le__)):
        if bound is None:
            continue
        inside = inside & keep(F.col("epoch"), F.lit(float(bound)))
        if day:
            edge = F.date_from_unix_date(F.lit(int(bound // 86400)))
            same = keep(F.col("day"), edge)
            inside = inside & same
            undated = undated & F.col("day").isNull()
    return inside | undated if keep_undated else inside & F.col("epoch").isNotNull()


def contains_text(query: str) -> Column:
    """Keyword in message or raw line, upper and lower case alike."""
    q = F.lit(query.lower())
    return F.contains(F.lower("message"), q) | F.contains(F.lower("raw"), q)


def matches_regex(df: DataFrame, query: str) -> Column:
    """Regex in message or raw line; a bad one is searched as plain text."""
    pattern = f"(?i){query}"
    try:
        # Constant folding runs the pattern here instead of inside tasks.
        df.sparkSession.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        warnings.warn(f"not a regular expression, searching as text: {query}", stacklevel=2)
        return contains_text(query)
    return F.col("message").rlike(pattern) | F.col("raw").rlike(pattern)


def filter_logs(
    logs: DataFrame,
    *,
    query: str | None = None,
    is_regex: bool = False,
    levels: list[str] | None = None,
    services: list[str] | None = None,
    template_id: int | None = None,
    start_epoch: float | None = None,
    end_epoch: float | None = None,
    keep_undated: bool = True,
) -> DataFrame:
    """Rows that pass all given filters; cheap tests come first, text last."""
    tests = []
    if levels:
        tests.append(level_in(levels))
    if services:
        tests.append(service_in(services))
    if template_id is not None:
        tests.append(F.col("template_id") == template_id)
    if start_epoch is not None or end_epoch is not None:
        tests.append(time_between(start_epoch, end_epoch, keep_undated, day="day" in logs.columns))
    if query:
        tests.append(matches_regex(logs, query) if is_regex else contains_text(query))
    for test in tests:
        logs = logs.where(test)
    return logs


def errors_only(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("level") == fv.ERROR_LEVELS[0])


def _order(order_by: str, descending: bool, columns: tuple[str, ...] = ORDER) -> list[Column]:
    keys = {"ingest": columns, "time": ("epoch", *columns)}[order_by]
    return [F.col(k).desc() if descending else F.col(k).asc() for k in keys]


def sort_logs(logs: DataFrame, order_by: str = "ingest", descending: bool = True) -> DataFrame:
    return logs.orderBy(*_order(order_by, descending))


def page_logs(
    logs: DataFrame, limit: int = 100, offset: int = 0, order_by: str = "ingest", descending: bool = True
) -> DataFrame:
    """One page of the sorted rows."""
    return sort_logs(logs, order_by, descending).offset(offset).limit(limit)


def page_after(logs: DataFrame, last: tuple[str, int] | None, limit: int = 100, descending: bool = True) -> DataFrame:
    """The page after the row at ``last`` (source, line_number).

    Deep pages by offset sort all rows before them; this reads from a key.
    """
    if last is not None:
        source, line = F.lit(last[0]), F.lit(last[1])
        same = F.col("source") == source
        if descending:
            logs = logs.where((F.col("source") <= source) & (~same | (F.col("line_number") < line)))
        else:
            logs = logs.where((F.col("source") >= source) & (~same | (F.col("line_number") > line)))
    return logs.orderBy(*_order("ingest", descending)).limit(limit)


def count_matched(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("total"))
