"""Whole views of a log table, from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.operators import anomalies as an
from logloom.operators import filters as fl
from logloom.operators import metrics as mt
from logloom.operators import templates as tm
from logloom.operators.parse import parse_logs
from logloom.schema import LOG_COLUMNS
from logloom.sources.datasets import load_dataset, save_dataset
from logloom.sources.text import read_log_lines, require_lines
from logloom.sources.workspace import stored


def _templates_path(out: str) -> str:
    return f"{out.rstrip('/')}_templates"


def ingest(spark: SparkSession, paths: str | list[str], out: str, year: int | None = None) -> DataFrame:
    """Read text files, parse them, number their templates, and store the log
    table once for all later queries, with its templates beside it."""
    lines = require_lines(read_log_lines(spark, paths, decode=True))
    parsed = stored(parse_logs(lines, year), "parsed")
    mined = tm.mine_templates(parsed)
    save_dataset(tm.assign_templates(parsed, mined, same_logs=True).select(*LOG_COLUMNS, "template_id"), out)
    logs = load_dataset(spark, out)
    tm.template_summary(logs, mined.latest()).write.parquet(_templates_path(out))
    return logs


def load_templates(spark: SparkSession, out: str) -> DataFrame:
    """Summary of the templates of a dataset that :func:`ingest` stored."""
    return spark.read.parquet(_templates_path(out))


def with_templates(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored rows with template_id, summary of the templates) of a table
    that :func:`ingest` hasn't stored."""
    mined = tm.mine_templates(logs)
    rows = stored(tm.assign_templates(logs, mined, same_logs=True), "rows")
    return rows, tm.template_summary(rows, mined.latest())


def overview(logs: DataFrame, templates: DataFrame, limit: int = 50, offset: int = 0, **filters) -> dict[str, DataFrame]:
    """One page of filtered rows, their total, and the metrics, templates and
    findings of the whole table.

    Give it a dataset and the templates stored with it: every part is a query
    of its own over them. Nothing is stored; the findings checkpoint a small
    table of counts.
    """
    matched = fl.filter_logs(logs, **filters)
    return {
        "logs": fl.page_logs(matched, limit, offset),
        "total": fl.count_matched(matched),
        **{f"metrics.{name}": df for name, df in mt.compute_metrics(logs).items()},
        "templates": templates,
        "anomalies": an.all_anomalies(logs, templates),
    }
