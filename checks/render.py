"""Log rows and log lines made from the ``events`` table.

Both engines run the same select text. Spark renders each row as a raw line of
some format and parses it back; DuckDB selects the columns that must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.normalize import epoch_of
from logloom.schema import LOG_SCHEMA, row_id
from logloom.sources.workspace import new_dir

MESSAGE = """CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'Failed password for user ' || CAST(user_id AS STRING) || ' from 10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING) || ' port ' || CAST(40000 + event_id % 20000 AS STRING)
      WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'Connection refused by db after ' || CAST(event_id % 900 AS STRING) || ' tries, pool exhausted'
      WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'Call to http://svc-' || CAST(user_id % 6 AS STRING) || ':8080/v1/charge failed: 504 Gateway Timeout'
      WHEN event_type = 'error' THEN 'NullPointerException in handler ' || CAST(event_id % 7 AS STRING)
      WHEN event_type = 'signup' THEN 'Rate limit threshold near for user ' || CAST(user_id AS STRING)
      WHEN event_type = 'purchase' THEN 'Payment accepted for order ' || CAST(event_id AS STRING) || ' user ' || CAST(user_id AS STRING)
      WHEN event_type = 'view' THEN 'GET /api/v1/items/' || CAST(event_id % 500 AS STRING) || ' took ' || CAST(event_id % 90 AS STRING) || ' ms'
      ELSE 'Click on item ' || CAST(event_id % 500 AS STRING) END"""

# Some errors get a word of their own, so that rare templates exist.
RARE_MESSAGE = f"""({MESSAGE}) || CASE WHEN event_type = 'error' AND event_id % 997 = 3
      THEN ' build b' || CAST(event_id AS STRING) || 'x' ELSE '' END"""

# Two words that no mask removes, so that templates get wildcards.
NAMED_MESSAGE = f"""({MESSAGE}) || ' by ' || chr(CAST(97 + user_id % 26 AS INT)) || 'q on ' || chr(CAST(97 + event_id % 26 AS INT))"""

LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"

# Errors of two days only, so that they stand out as a burst.
SPIKY_LEVEL = f"""CASE WHEN event_type = 'error' AND (ts < TIMESTAMP_NTZ '2024-01-10 00:00:00' OR ts >= TIMESTAMP_NTZ '2024-01-12 00:00:00')
      THEN 'INFO' ELSE {LEVEL} END"""


def select_text(level: str = LEVEL, message: str = MESSAGE) -> str:
    return f"""SELECT event_id, event_id + 1 AS line_number, user_id, event_type, value, ts AS ts0,
 {level} AS level,
 'svc-' || CAST(user_id % 6 AS STRING) AS service,
 '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING) AS client_ip,
 CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 500 WHEN 1 THEN 502 WHEN 2 THEN 504 WHEN 3 THEN 401 ELSE 403 END
      WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status_code,
 {message} AS message
FROM events"""


def logs_sql(level: str = LEVEL, message: str = MESSAGE) -> str:
    """``WITH logs AS (..)`` for DuckDB."""
    text = select_text(level.replace("TIMESTAMP_NTZ", "TIMESTAMP"), message)
    return f"WITH logs AS (SELECT *, 'events' AS source, epoch_us(ts0) / 1e6 AS epoch FROM ({text}))"


def events(spark: SparkSession, sf: str, level: str = LEVEL, message: str = MESSAGE) -> DataFrame:
    """The rendered columns in Spark, with ``ts`` as a timestamp."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = select_text(level, message).replace("FROM events", "FROM {events}")
    # A small test table is one split.
    table = spark.read.parquet(f"{sf}/events.parquet").repartition(spark.sparkContext.defaultParallelism)
    rows = spark.sql(text, events=table)
    return rows.withColumn("ts", F.col("ts0").cast("timestamp"))


def log_table(spark: SparkSession, sf: str, level: str = LEVEL, message: str = MESSAGE) -> DataFrame:
    """The rendered rows as a log table."""
    rows = events(spark, sf, level, message).withColumn("source", F.lit("events"))
    known: dict[str, Column] = {
        "id": row_id(),
        "parser": F.lit("events"),
        "epoch": epoch_of(F.col("ts")),
        "raw": F.col("message"),
    }
    have = {"source", "line_number", "ts", "level", "service", "message", "status_code", "client_ip"}
    columns = []
    for f in LOG_SCHEMA:
        value = known.get(f.name, F.col(f.name) if f.name in have else F.lit(None))
        columns.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*columns)


# --- lines ------------------------------------------------------------------------



def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def iso_text() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def plain_text() -> Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")


def json_line() -> Column:
    return F.to_json(
        F.struct(
            iso_text().alias("timestamp"),
            F.lower("level").alias("level"),
            "service",
            "message",
            "client_ip",
            "status_code",
            F.col("user_id").alias("user"),
        )
    )


def access_line() -> Column:
    path = _cat("/api/v1/items/", (F.col("event_id") % 500).cast("string"))
    return _cat(
        F.col("client_ip"), " - u", (F.col("user_id") % 9).cast("string"), " [",
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET ', path, ' HTTP/1.1" ',
        F.col("status_code").cast("string"), " ", F.floor(F.col("value") * 100).cast("string"),
        ' "-" "agent/', (F.col("event_id") % 5).cast("string"), '"',
    )


def syslog_3164_line() -> Column:
    return _cat(
        F.date_format("ts", "MMM dd HH:mm:ss"), " host-", (F.col("user_id") % 5).cast("string"), " ",
        F.col("service"), "[", F.col("user_id").cast("string"), "]: ", F.col("message"),
    )


def syslog_5424_line() -> Column:
    severity = F.expr(
        "CASE event_type WHEN 'error' THEN CAST(2 + event_id % 2 AS INT) WHEN 'signup' THEN 4 "
        "WHEN 'click' THEN 5 WHEN 'purchase' THEN 6 ELSE 7 END"
    )
    pri = (F.col("user_id") % 24) * 8 + severity
    app = F.when(F.col("event_id") % 10 == 0, "-").otherwise(F.col("service"))
    return _cat(
        "<", pri.cast("string"), ">1 ", iso_text(), " host-", (F.col("user_id") % 5).cast("string"), " ", app,
        " ", F.col("user_id").cast("string"), ' ID7 [x@1 k="v"] ', F.col("message"),
    )


def logfmt_line() -> Column:
    return _cat(
        "ts=", iso_text(), " level=", F.lower("level"), " service=", F.col("service"), ' msg="', F.col("message"),
        '" user=', F.col("user_id").cast("string"), " user=", F.col("event_id").cast("string"),
    )


def spring_line() -> Column:
    return _cat(
        plain_text(), "  ", F.col("level"), " ", F.col("user_id").cast("string"), " --- [worker-",
        (F.col("event_id") % 3).cast("string"), "] c.acme.", F.col("service"), " : ", F.col("message"),
    )


def generic_line() -> Column:
    return _cat(plain_text(), " [", F.col("level"), "] [", F.col("service"), "] ", F.col("message"))


LINES = {
    "json": json_line,
    "springboot": spring_line,
    "nginx_apache": access_line,
    "syslog": syslog_3164_line,
    "logfmt": logfmt_line,
    "generic_standard": generic_line,
}


def lines(spark: SparkSession, sf: str, line: Column, source: str | Column = "events") -> DataFrame:
    source = source if isinstance(source, Column) else F.lit(source)
    return events(spark, sf).select(source.alias("source"), "line_number", line.alias("line"))


def spring_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Header lines, with two trace lines after each error."""
    trace = [
        _cat("java.lang.IllegalStateException: state ", (F.col("event_id") % 11).cast("string")),
        _cat("\tat c.acme.Handler.run(Handler.java:", (F.col("event_id") % 300).cast("string"), ")"),
    ]
    texts = F.when(F.col("level") == "ERROR", F.array(spring_line(), *trace)).otherwise(F.array(spring_line()))
    rows = events(spark, sf).select("event_id", F.posexplode(texts).alias("pos", "line"))
    number = F.col("event_id") * 3 + F.col("pos") + 1
    return rows.select(F.lit("events").alias("source"), number.alias("line_number"), "line")


def mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Seven sources: one per format, and one that only starts as JSON."""
    kind, place = F.col("event_id") % 7, F.floor(F.col("event_id") / 7) + 1
    names = list(LINES)
    line = F.when(place <= 20, json_line()).otherwise(generic_line())
    for i, name in enumerate(names):
        line = F.when(kind == i, LINES[name]()).otherwise(line)
    source = F.element_at(F.array(*[F.lit(n) for n in [*names, "changing"]]), (kind + 1).cast("int"))
    return events(spark, sf).select(source.alias("source"), place.alias("line_number"), line.alias("line"))


def text_files(spark: SparkSession, sf: str, line: Column, rows_per_file: int = 1000) -> str:
    """Lines as text files of 1,000 lines each; gives the folder."""
    path = new_dir(spark, "text")
    shard = F.floor(F.col("event_id") / rows_per_file).alias("shard")
    rows = events(spark, sf).select(shard, "event_id", line.alias("value")).repartition("shard")
    rows.sortWithinPartitions("shard", "event_id").drop("event_id").write.partitionBy("shard").text(path)
    return path
