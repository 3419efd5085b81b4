"""Streams over the events table and over text files made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import render as r
from checks.mining import FOUND
from checks.registry import query
from logloom.operators import parse as P
from logloom.sources.text import read_log_stream
from logloom.sources.workspace import new_dir
from logloom.streaming import live

LOGS = r.logs_sql()
MILLIS = "(epoch_us(ts0) // 1000) * 1000 / 1e6"


def _log_stream(spark: SparkSession, sf: str, level: str = r.LEVEL, message: str = r.MESSAGE) -> DataFrame:
    """The events table as a stream of log rows."""
    return _in_parts(r.log_table(spark, sf, level, message))


# Rows that a file of a stream has at least, where there is more than one per batch.
FILE_ROWS = 100_000


def _in_parts(rows: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """A stream that gets the rows in four micro-batches, in line order.

    A batch is as many files as its rows need, the same number in each, so that
    it is written and read by many tasks.
    """
    path = new_dir(rows.sparkSession, "stream")
    cuts = rows.agg(F.max("line_number")).first()[0] or 0
    parts = [(F.col("line_number") > cuts * i // 4) & (F.col("line_number") <= cuts * (i + 1) // 4) for i in range(4)]
    files = max(1, min(rows.agg(*[F.count_if(part) for part in parts]).first()) // file_rows)
    for part in parts:
        rows.where(part).repartition(files).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table, and read the table."""
    spark = stream.sparkSession
    out, state = new_dir(spark, "out"), new_dir(spark, "state")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    else:
        writer = live.run_step(stream, lambda batch, _: batch.write.mode("overwrite").parquet(out), state).outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _step(stream: DataFrame, step: live.Step) -> None:
    spark = stream.sparkSession
    live.run_step(stream, step, new_dir(spark, "state")).trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_parse",
    f"""{LOGS} SELECT event_id % 1000 + 1 AS line_number, (SELECT count(*) FROM logs) AS n_ids, {MILLIS} AS epoch, level, service, message,
 CAST(status_code AS BIGINT) AS status_code FROM logs""",
)
def _(spark, sf):
    lines = read_log_stream(spark, f"{r.text_files(spark, sf, r.json_line())}/*", max_files=3)
    out = new_dir(spark, "rows")
    _step(lines, live.numbered(P.parse_json, live.keep_rows(out)))
    logs = spark.read.parquet(out)
    ids = F.lit(logs.select("id").distinct().count()).alias("n_ids")
    return logs.select("line_number", ids, "epoch", "level", "service", "message", F.col("status_code").cast("bigint").alias("status_code"))


@query("stream_tail", f"{LOGS} SELECT line_number, epoch, message FROM logs ORDER BY ts0 DESC, line_number DESC LIMIT 50")
def _(spark, sf):
    out = new_dir(spark, "tail")
    _step(_log_stream(spark, sf), live.keep_newest(out, 50))
    return live.last_folder(spark, out).select("line_number", "epoch", "message")


@query("stream_level_counts", f"{LOGS} SELECT level, count(*) AS n FROM logs GROUP BY level")
def _(spark, sf):
    return _table(live.stream_level_counts(_log_stream(spark, sf)), "complete")


@query(
    "stream_error_rate",
    f"""{LOGS} SELECT count(*) AS total, count(*) FILTER (level = 'ERROR') AS errors,
 round(count(*) FILTER (level = 'ERROR') * 100e0 / count(*), 2) AS error_rate FROM logs""",
)
def _(spark, sf):
    return _table(live.stream_error_rate(_log_stream(spark, sf)), "complete")


@query(
    "stream_histogram",
    f"""{LOGS} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts0)) AS start_us, count(*) AS total,
 count(*) FILTER (level = 'INFO') AS "INFO", count(*) FILTER (level = 'WARN') AS "WARN", count(*) FILTER (level = 'ERROR') AS "ERROR",
 count(*) FILTER (level = 'DEBUG') AS "DEBUG", CAST(0 AS BIGINT) AS "OTHER"
 FROM logs GROUP BY 1 HAVING start_us + 3600000000 <= (SELECT epoch_us(max(ts0)) FROM logs) - 600000000""",
)
def _(spark, sf):
    table = _table(live.stream_histogram(_log_stream(spark, sf)))
    return table.select(F.unix_micros("start").alias("start_us"), "total", "INFO", "WARN", "ERROR", "DEBUG", "OTHER")


@query(
    "stream_auth_failures",
    f"""{LOGS}, both_windows AS (SELECT client_ip, (epoch_us(ts0) // 300000000 - k) * 300000000 AS start_us
 FROM logs, (SELECT unnest([0, 1]) AS k) WHERE contains(lower(message), 'failed password'))
 SELECT start_us, client_ip AS auth_source, count(*) AS n FROM both_windows GROUP BY 1, 2
 HAVING start_us + 600000000 <= (SELECT epoch_us(max(ts0)) FROM logs) - 600000000""",
)
def _(spark, sf):
    table = _table(live.stream_auth_failures(_log_stream(spark, sf)))
    return table.select(F.unix_micros("start").alias("start_us"), "auth_source", "n")


@query(
    "stream_error_bursts",
    f"""{r.logs_sql(level=r.SPIKY_LEVEL)}, b AS (SELECT CAST(floor(epoch / 86400) AS BIGINT) AS bucket, count(*) AS total,
 count(*) FILTER (level = 'ERROR') AS errors FROM logs GROUP BY 1), base AS (SELECT avg(errors) AS a, stddev_pop(errors) AS s FROM b)
 SELECT bucket, total, errors, CASE WHEN s > 0 AND (errors - a) / s > 2 THEN 'high' WHEN errors / total > 0.6 THEN 'critical' ELSE 'high' END AS severity
 FROM b, base WHERE errors >= 3 AND ((s > 0 AND (errors - a) / s > 2) OR errors / total > 0.35)""",
)
def _(spark, sf):
    counts, alerts = new_dir(spark, "counts"), new_dir(spark, "alerts")
    _step(_log_stream(spark, sf, r.SPIKY_LEVEL), live.watch_bursts(counts, alerts, 86_400))
    return live.last_folder(spark, alerts).select("bucket", "total", "errors", "severity")


@query("stream_templates", FOUND)
def _(spark, sf):
    out = new_dir(spark, "templates")
    _step(_log_stream(spark, sf, message=r.NAMED_MESSAGE), live.keep_templates(out))
    return live.stored_templates(spark, out).latest().select("template_id", "template")


@query(
    "stream_multiline",
    f"""{LOGS} SELECT event_id * 3 + 1 AS line_number, level, CASE WHEN level = 'ERROR' THEN message || chr(10) ||
 'java.lang.IllegalStateException: state ' || CAST(event_id % 11 AS VARCHAR) || chr(10) ||
 'at c.acme.Handler.run(Handler.java:' || CAST(event_id % 300 AS VARCHAR) || ')' ELSE message END AS message FROM logs""",
)
def _(spark, sf):
    out = new_dir(spark, "multiline")
    _step(_in_parts(r.spring_lines(spark, sf)), live.keep_multiline(out))
    rows = live.multiline_rows(spark, out).unionByName(live.flush_multiline(spark, out))
    return rows.select("line_number", "level", "message")
