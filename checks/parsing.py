"""Normalisers, sources and parse jobs.

The twins of the parse jobs select the columns that lines were made of, so
they do not repeat any pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import render as r
from checks.registry import query
from logloom.functions import normalize as nz
from logloom.functions.capture import evaluate_once
from logloom.operators import parse as P
from logloom.schema import LOG_SCHEMA
from logloom.sources import datasets as ds
from logloom.sources.text import decode_lines, read_log_lines
from logloom.sources.workspace import new_dir, stored

LOGS = r.logs_sql()
MILLIS = "(epoch_us(ts0) // 1000) * 1000 / 1e6"
SECONDS = "(epoch_us(ts0) // 1000000) * 1000000 / 1e6"


def big():
    return F.col("status_code").cast("bigint").alias("status_code")


# --- normalisers ----------------------------------------------------------------

_WORDS = """CASE event_id % 16 WHEN 0 THEN 'e' WHEN 1 THEN ' Err' WHEN 2 THEN 'fatal' WHEN 3 THEN 'CRIT ' WHEN 4 THEN 'Severe'
 WHEN 5 THEN 'panic' WHEN 6 THEN 'w' WHEN 7 THEN 'Warning' WHEN 8 THEN 'inf' WHEN 9 THEN 'notice' WHEN 10 THEN 'dbg'
 WHEN 11 THEN 'D' WHEN 12 THEN 'verbose' WHEN 13 THEN 't' WHEN 14 THEN '50' ELSE 'what' END"""


@query(
    "normalize_level",
    f"""{LOGS} SELECT line_number, CASE WHEN event_id % 16 <= 5 THEN 'ERROR' WHEN event_id % 16 <= 7 THEN 'WARN'
 WHEN event_id % 16 <= 9 THEN 'INFO' WHEN event_id % 16 <= 11 THEN 'DEBUG' WHEN event_id % 16 <= 13 THEN 'TRACE'
 ELSE 'INFO' END AS level FROM logs""",
)
def _(spark, sf):
    return r.events(spark, sf).select("line_number", nz.normalize_level(F.expr(_WORDS)).alias("level"))


@query(
    "parse_timestamp",
    f"""{LOGS} SELECT line_number, CASE event_id % 8 WHEN 0 THEN {MILLIS} WHEN 1 THEN {SECONDS} WHEN 2 THEN epoch
 WHEN 3 THEN {MILLIS} WHEN 4 THEN {SECONDS} - 7200 WHEN 5 THEN {SECONDS} WHEN 6 THEN {SECONDS} - 19800 END AS epoch,
 CASE WHEN event_id % 8 = 7 THEN 'at ' || CAST(event_id AS VARCHAR) END AS ts_raw FROM logs""",
)
def _(spark, sf):
    forms = [
        r.iso_text(),
        F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("]")),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss' +0200'"),
        F.concat(F.lit(" "), F.date_format("ts", "MMM d HH:mm:ss")),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'"),
        F.concat(F.lit("at "), F.col("event_id").cast("string")),
    ]
    text = F.coalesce(*[F.when(F.col("event_id") % 8 == i, form) for i, form in enumerate(forms)])
    lines = evaluate_once(r.events(spark, sf), "text", text).select("line_number", "text")
    parsed = evaluate_once(lines, "t", nz.parse_timestamp(F.col("text"), 2024))
    return parsed.select("line_number", "t.epoch", "t.ts_raw")


@query("syslog_timestamp", f"{LOGS} SELECT line_number, {SECONDS} AS epoch FROM logs")
def _(spark, sf):
    text = F.date_format("ts", "MMM dd  HH:mm:ss")
    ts = nz.parse_syslog_timestamp(text, F.year("ts"))
    return r.events(spark, sf).select("line_number", nz.epoch_of(ts).alias("epoch"))


@query(
    "level_from_status",
    f"""{LOGS} SELECT line_number, CASE WHEN event_type <> 'error' THEN 'INFO' WHEN event_id % 5 < 3 THEN 'ERROR'
 ELSE 'WARN' END AS level FROM logs""",
)
def _(spark, sf):
    return r.events(spark, sf).select("line_number", nz.level_from_status(F.col("status_code")).alias("level"))


@query(
    "syslog_severity",
    f"""{LOGS} SELECT line_number, user_id % 24 AS facility,
 ['CRITICAL', 'CRITICAL', 'CRITICAL', 'ERROR', 'WARN', 'INFO', 'INFO', 'DEBUG'][1 + event_id % 8] AS level FROM logs""",
)
def _(spark, sf):
    pri = (F.col("user_id") % 24) * 8 + F.col("event_id") % 8
    return r.events(spark, sf).select(
        "line_number", nz.facility_of(pri).alias("facility"), nz.level_from_severity(pri).alias("level")
    )


_KEYWORD_LEVEL = """CASE WHEN lower(message) LIKE '%failed%' OR lower(message) LIKE '%error%' OR lower(message) LIKE '%fatal%'
 OR lower(message) LIKE '%critical%' OR lower(message) LIKE '%denied%' OR lower(message) LIKE '%segfault%'
 OR lower(message) LIKE '%panic%' THEN 'ERROR' WHEN lower(message) LIKE '%warn%' THEN 'WARN' ELSE 'INFO' END"""


@query("level_from_keywords", f"{LOGS} SELECT line_number, {_KEYWORD_LEVEL} AS level FROM logs")
def _(spark, sf):
    return r.events(spark, sf).select("line_number", nz.level_from_keywords(F.col("message")).alias("level"))


@query(
    "short_logger",
    f"{LOGS} SELECT line_number, CASE WHEN event_id % 3 = 0 THEN service ELSE service || 'Impl' END AS logger FROM logs",
)
def _(spark, sf):
    dotted = F.concat(F.lit("com.acme."), F.col("service"), F.lit("Impl"))
    name = F.when(F.col("event_id") % 3 == 0, F.col("service")).otherwise(dotted)
    return r.events(spark, sf).select("line_number", nz.short_logger(name).alias("logger"))


def _alias_lines(spark, sf) -> DataFrame:
    """JSON lines whose keys go through the aliases; some hold empty or unused ones."""
    k = F.col("event_id") % 4
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    pairs = F.create_map(
        pick("@timestamp", "time", "ts", "created_at"), r.iso_text(),
        pick("level", "severity", "lvl", "type"), F.col("level"),
        pick("message", "msg", "event", "details"), F.col("message"),
        pick("service", "app", "logger", "source"), F.col("service"),
        F.lit("user"), F.col("user_id").cast("string"),
        F.lit("component"), F.when(k == 3, F.lit("")).otherwise(F.lit("unused")),
        F.when(k == 2, F.lit("tag")).otherwise(F.lit("date")), F.when(k == 2, F.lit("t")).otherwise(F.lit("")),
    )
    return r.lines(spark, sf, F.to_json(pairs))


@query(
    "json_aliases",
    f"""{LOGS} SELECT line_number, {MILLIS} AS epoch, level,
 CASE WHEN event_id % 4 = 2 THEN 'unused' ELSE service END AS service, message FROM logs""",
)
def _(spark, sf):
    return P.parse_json(_alias_lines(spark, sf)).select("line_number", "epoch", "level", "service", "message")


@query(
    "json_metadata",
    f"""{LOGS} SELECT line_number, 'user' AS key, CAST(user_id AS VARCHAR) AS value FROM logs
 UNION ALL SELECT line_number, 'tag', 't' FROM logs WHERE event_id % 4 = 2""",
)
def _(spark, sf):
    return P.parse_json(_alias_lines(spark, sf)).select("line_number", F.explode("metadata").alias("key", "value"))


# --- parse jobs -----------------------------------------------------------------

_BASE = ["line_number", "epoch", "level", "service", "message"]


@query(
    "parse_json",
    f"""{LOGS} SELECT line_number, {MILLIS} AS epoch, level, service, message, client_ip,
 CAST(status_code AS BIGINT) AS status_code, CAST(user_id AS VARCHAR) AS user_name FROM logs""",
)
def _(spark, sf):
    logs = P.parse_json(r.lines(spark, sf, r.json_line()))
    return logs.select(*_BASE, "client_ip", big(), F.col("metadata")["user"].alias("user_name"))


@query(
    "parse_access_log",
    f"""{LOGS} SELECT line_number, {SECONDS} AS epoch, 'web-server' AS service, client_ip,
 CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARN' ELSE 'INFO' END AS level,
 'GET /api/v1/items/' || CAST(event_id % 500 AS VARCHAR) || ' HTTP ' || CAST(status_code AS VARCHAR) AS message,
 CAST(status_code AS BIGINT) AS status_code, CAST(floor(value * 100) AS BIGINT) AS bytes_sent,
 'agent/' || CAST(event_id % 5 AS VARCHAR) AS user_agent, 'u' || CAST(user_id % 9 AS VARCHAR) AS auth_user,
 CAST(NULL AS VARCHAR) AS referrer FROM logs""",
)
def _(spark, sf):
    logs = P.parse_access_log(r.lines(spark, sf, r.access_line()))
    m = F.col("metadata")
    return logs.select(
        *_BASE, "client_ip", big(), m["bytes_sent"].cast("bigint").alias("bytes_sent"),
        *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("user_agent", "auth_user", "referrer")],
    )


@query(
    "parse_syslog_5424",
    f"""{LOGS} SELECT line_number, {MILLIS} AS epoch, message, 'host-' || CAST(user_id % 5 AS VARCHAR) AS host,
 CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'CRITICAL' ELSE 'ERROR' END WHEN 'signup' THEN 'WARN'
 WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
 CASE WHEN event_id % 10 = 0 THEN 'host-' || CAST(user_id % 5 AS VARCHAR) ELSE service END AS service,
 CAST(user_id AS VARCHAR) AS proc_id, CAST(user_id % 24 AS VARCHAR) AS facility FROM logs""",
)
def _(spark, sf):
    logs = P.parse_syslog_5424(r.lines(spark, sf, r.syslog_5424_line()))
    m = F.col("metadata")
    return logs.select(*_BASE, "host", m["proc_id"].alias("proc_id"), m["facility"].alias("facility"))


@query(
    "parse_syslog_3164",
    f"""{LOGS} SELECT line_number, {SECONDS} AS epoch, message, service, 'host-' || CAST(user_id % 5 AS VARCHAR) AS host,
 {_KEYWORD_LEVEL} AS level, CAST(user_id AS VARCHAR) AS pid FROM logs""",
)
def _(spark, sf):
    logs = P.parse_syslog_3164(r.lines(spark, sf, r.syslog_3164_line()), year=2024)
    return logs.select(*_BASE, "host", F.col("metadata")["pid"].alias("pid"))


@query(
    "parse_logfmt",
    f"""{LOGS} SELECT line_number, {MILLIS} AS epoch, level, service, message,
 CAST(event_id AS VARCHAR) AS user_name FROM logs""",
)
def _(spark, sf):
    logs = P.parse_logfmt(r.lines(spark, sf, r.logfmt_line()))
    return logs.select(*_BASE, F.col("metadata")["user"].alias("user_name"))


@query(
    "parse_springboot",
    f"""{LOGS} SELECT line_number, {MILLIS} AS epoch, level, service, message, CAST(user_id AS VARCHAR) AS pid,
 'worker-' || CAST(event_id % 3 AS VARCHAR) AS thread, 'c.acme.' || service AS logger FROM logs""",
)
def _(spark, sf):
    logs = P.parse_springboot(r.lines(spark, sf, r.spring_line()))
    m = F.col("metadata")
    return logs.select(*_BASE, *[m[k].alias(k) for k in ("pid", "thread", "logger")])


_TRACE = """'java.lang.IllegalStateException: state ' || CAST(event_id % 11 AS VARCHAR) || chr(10) ||
 'at c.acme.Handler.run(Handler.java:' || CAST(event_id % 300 AS VARCHAR) || ')'"""
_GROUPED = f"""SELECT event_id * 3 + 1 AS line_number, {MILLIS} AS epoch, level, service,
 CASE WHEN level = 'ERROR' THEN message || chr(10) || {_TRACE} ELSE message END AS message,
 CAST(CASE WHEN level = 'ERROR' THEN 2 ELSE 0 END AS BIGINT) AS trace_lines FROM logs"""


def _grouped(logs: DataFrame) -> DataFrame:
    return logs.select(*_BASE, F.coalesce(F.size("stack_trace"), F.lit(0)).cast("bigint").alias("trace_lines"))


@query("group_multiline", f"{LOGS} {_GROUPED}")
def _(spark, sf):
    return _grouped(P.group_multiline(r.spring_lines(spark, sf)))


@query("parse_generic", f"{LOGS} SELECT line_number, {MILLIS} AS epoch, level, service, message FROM logs")
def _(spark, sf):
    return P.parse_generic(r.lines(spark, sf, r.generic_line())).select(*_BASE)


# --- detection ------------------------------------------------------------------

_FORMATS = "['json', 'springboot', 'nginx_apache', 'syslog', 'logfmt', 'generic_standard', 'changing'][1 + event_id % 7]"
_PLACE = "event_id // 7 + 1"


def _broken_lines(spark, sf) -> DataFrame:
    """The mixed sources with junk in every fifth line and every eleventh blank."""
    n = F.col("line_number")
    line = F.when(n % 5 == 0, F.lit("not a log line")).when(n % 11 == 0, F.lit("  ")).otherwise(F.col("line"))
    return r.mixed_lines(spark, sf).withColumn("line", line)


@query(
    "detect_format",
    f"""SELECT {_FORMATS} AS source, replace({_FORMATS}, 'changing', 'json') AS parser,
 avg(CASE WHEN ({_PLACE}) % 5 = 0 THEN 0.0 ELSE 1.0 END) AS score FROM events
 WHERE {_PLACE} <= 20 AND (({_PLACE}) % 5 = 0 OR ({_PLACE}) % 11 <> 0) GROUP BY 1, 2""",
)
def _(spark, sf):
    return P.detect_format(_broken_lines(spark, sf))


@query(
    "parse_logs_mixed",
    f"""{LOGS}, placed AS (SELECT *, {_FORMATS} AS src, {_PLACE} AS place FROM logs)
 SELECT src AS source, place AS line_number, replace(src, 'changing', 'generic_standard') AS parser,
 CASE WHEN src = 'nginx_apache' OR src = 'syslog' THEN {SECONDS} ELSE {MILLIS} END AS epoch,
 CASE WHEN src = 'syslog' THEN {_KEYWORD_LEVEL}
      WHEN src = 'nginx_apache' THEN CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARN' ELSE 'INFO' END
      ELSE level END AS level,
 CASE WHEN src = 'nginx_apache' THEN 'web-server' ELSE service END AS service,
 CASE WHEN src = 'nginx_apache' THEN 'GET /api/v1/items/' || CAST(event_id % 500 AS VARCHAR) || ' HTTP ' || CAST(status_code AS VARCHAR)
      ELSE message END AS message
 FROM placed WHERE src <> 'changing' OR place > 20""",
)
def _(spark, sf):
    lines = stored(r.mixed_lines(spark, sf), "lines")  # read several times
    logs = P.parse_logs(lines, year=2024)
    return logs.select("source", "line_number", "parser", "epoch", "level", "service", "message")


# --- sources and sinks ------------------------------------------------------------

@query(
    "read_log_lines",
    f"""{LOGS} SELECT event_id // 1000 AS shard, event_id % 1000 + 1 AS line_number,
 CASE WHEN event_id % 13 = 0 THEN '' ELSE message END AS line FROM logs""",
)
def _(spark, sf):
    line = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("message"))
    lines = read_log_lines(spark, f"{r.text_files(spark, sf, line)}/*")
    shard = F.regexp_extract("source", r"shard=(\d+)", 1).cast("bigint").alias("shard")
    return lines.select(shard, "line_number", "line")


@query(
    "decode_fallback",
    f"""{LOGS} SELECT line_number, 'src-' || CAST(user_id % 4 AS VARCHAR) AS source,
 message || CASE WHEN event_id % 3 = 0 THEN ' café ñ' ELSE '' END AS line FROM logs""",
)
def _(spark, sf):
    text = F.concat("message", F.when(F.col("event_id") % 3 == 0, " café ñ").otherwise(""))
    latin1 = F.encode(text, "ISO-8859-1").cast("string")
    kind = F.col("user_id") % 4
    line = F.when(kind < 2, latin1).otherwise(text)
    return decode_lines(r.lines(spark, sf, line, F.concat(F.lit("src-"), kind.cast("string"))))


_EXPORT = f"""{LOGS} SELECT strftime(ts0, '%Y-%m-%dT%H:%M:%S') ||
 CASE WHEN epoch_us(ts0) % 1000000 = 0 THEN '' ELSE strftime(ts0, '.%f') END || '+00:00' AS "Timestamp",
 level AS "Level", CASE WHEN event_id % 10 = 0 THEN NULL ELSE service END AS "Service",
 message || CASE WHEN event_id % 7 = 0 THEN ', "quoted"' || chr(10) || 'next' ELSE '' END AS "Message",
 'events' AS "Source", CAST(line_number AS VARCHAR) AS "Line" FROM logs"""


def _export_rows(spark, sf) -> DataFrame:
    k = F.col("line_number") - 1
    return r.log_table(spark, sf).withColumns(
        {
            "service": F.when(k % 10 != 0, F.col("service")),
            "message": F.concat("message", F.when(k % 7 == 0, ', "quoted"\nnext').otherwise("")),
        }
    )


@query("export_csv", _EXPORT)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "csv")
    ds.write_csv(_export_rows(spark, sf), path)
    schema = ", ".join(f"{c} string" for c in ds.EXPORT_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query(
    "export_json",
    f"""{LOGS} SELECT line_number, epoch, level, CASE WHEN event_id % 10 = 0 THEN NULL ELSE service END AS service,
 message || CASE WHEN event_id % 7 = 0 THEN ', "quoted"' || chr(10) || 'next' ELSE '' END AS message,
 CAST(status_code AS BIGINT) AS status_code FROM logs""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "json")
    ds.write_json(_export_rows(spark, sf), path)
    return spark.read.schema(LOG_SCHEMA).json(path).select(*_BASE, big())


@query(
    "dataset_roundtrip",
    f"""{LOGS} SELECT line_number, {MILLIS} AS epoch, level, service, message, client_ip,
 CAST(status_code AS BIGINT) AS status_code, strftime(ts0, '%Y-%m-%d') AS day FROM logs""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = new_dir(spark, "dataset")
    ds.save_dataset(P.parse_json(r.lines(spark, sf, r.json_line())), path)
    return ds.load_dataset(spark, path).select(*_BASE, "client_ip", big(), F.col("day").cast("string").alias("day"))


@query(
    "list_datasets",
    "SELECT 'src-' || CAST(user_id % 4 AS VARCHAR) AS name, 'json' AS parser, count(*) AS log_count FROM events GROUP BY 1",
)
def _(spark, sf):
    source = F.concat(F.lit("src-"), (F.col("user_id") % 4).cast("string"))
    return ds.list_datasets(P.parse_json(r.lines(spark, sf, r.json_line(), source)))
