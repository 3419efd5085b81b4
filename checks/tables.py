"""Filters, metrics, anomalies and diagnosis over the log table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import render as r
from checks.mining import loop
from checks.registry import query
from logloom import fixed_values as fv
from logloom.operators import anomalies as an
from logloom.operators import diagnostics as dg
from logloom.operators import filters as fl
from logloom.operators import metrics as mt
from logloom.operators import templates as tm
from logloom.plans.overview import overview, with_templates
from logloom.schema import LOG_COLUMNS
from logloom.sources.datasets import load_dataset, save_dataset
from logloom.sources.workspace import new_dir

LOGS = r.logs_sql()
SPIKY = r.logs_sql(level=r.SPIKY_LEVEL)
ERR = "level = 'ERROR'"
_COLS = "line_number, epoch, level, service, message"
_NAMES = ["line_number", "epoch", "level", "service", "message"]


def _some_undated(spark, sf) -> DataFrame:
    """Every ninth row without a time, every tenth without a service."""
    k = F.col("line_number") - 1
    return r.log_table(spark, sf).withColumns(
        {
            "epoch": F.when(k % 9 != 0, F.col("epoch")),
            "ts": F.when(k % 9 != 0, F.col("ts")),
            "service": F.when(k % 10 != 0, F.col("service")),
        }
    )


UNDATED = f"""{LOGS}, part AS (SELECT * EXCLUDE (epoch, service), CASE WHEN event_id % 9 <> 0 THEN epoch END AS epoch,
 CASE WHEN event_id % 10 <> 0 THEN service END AS service FROM logs)"""

# --- filters --------------------------------------------------------------------


@query("filter_levels", f"{LOGS} SELECT {_COLS} FROM logs WHERE level IN ('ERROR', 'WARN')")
def _(spark, sf):
    return fl.filter_logs(r.log_table(spark, sf), levels=["error", "Warn"]).select(_NAMES)


@query("filter_services", f"{UNDATED} SELECT {_COLS} FROM part WHERE service IN ('svc-1', 'svc-4') OR service IS NULL")
def _(spark, sf):
    return fl.filter_logs(_some_undated(spark, sf), services=["svc-1", "svc-4", "unspecified"]).select(_NAMES)


@query("filter_template", f"{loop(r.logs_sql(message=r.RARE_MESSAGE))} SELECT {_COLS} FROM logs JOIN run ON run.k = logs.line_number WHERE id = 3")
def _(spark, sf):
    logs = r.log_table(spark, sf, message=r.RARE_MESSAGE)
    rows = tm.assign_templates(logs, tm.mine_templates(logs), same_logs=True)
    return fl.filter_logs(rows, template_id=3).select(_NAMES)


@query("filter_time_range", f"{UNDATED} SELECT {_COLS} FROM part WHERE epoch IS NULL OR epoch BETWEEN 1704672000 AND 1705276800")
def _(spark, sf):
    return fl.filter_logs(_some_undated(spark, sf), start_epoch=1704672000, end_epoch=1705276800).select(_NAMES)


@query("search_keyword", "SELECT doc_id AS line_number, lang FROM documents WHERE contains(lower(text), 'être')")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    logs = docs.select(F.col("doc_id").alias("line_number"), "lang", F.col("text").alias("message"), F.lit("").alias("raw"))
    return fl.filter_logs(logs, query="ÊTRE").select("line_number", "lang")


@query("search_regex", f"{LOGS} SELECT {_COLS} FROM logs WHERE regexp_matches(message, '(?i)POOL|time.ut$|port 4\\d{{3}}1')")
def _(spark, sf):
    return fl.filter_logs(r.log_table(spark, sf), query=r"POOL|time.ut$|port 4\d{3}1", is_regex=True).select(_NAMES)


@query("sort_logs", f"{UNDATED} SELECT {_COLS} FROM part")
def _(spark, sf):
    return fl.sort_logs(_some_undated(spark, sf), order_by="time").select(_NAMES)


@query("page_logs", f"{UNDATED} SELECT {_COLS} FROM part ORDER BY line_number DESC LIMIT 50 OFFSET 150")
def _(spark, sf):
    return fl.page_logs(_some_undated(spark, sf), limit=50, offset=150).select(_NAMES)


@query("page_after", f"{UNDATED} SELECT {_COLS} FROM part WHERE line_number < 801 ORDER BY line_number DESC LIMIT 50")
def _(spark, sf):
    return fl.page_after(_some_undated(spark, sf), ("events", 801), limit=50).select(_NAMES)


@query("count_matched", f"{LOGS} SELECT count(*) AS total FROM logs WHERE {ERR} AND service = 'svc-2' AND contains(lower(message), 'failed')")
def _(spark, sf):
    return fl.count_matched(fl.filter_logs(r.log_table(spark, sf), levels=["error"], services=["svc-2"], query="Failed"))


@query("errors_only", f"{LOGS} SELECT {_COLS} FROM logs WHERE {ERR}")
def _(spark, sf):
    return fl.errors_only(r.log_table(spark, sf)).select(_NAMES)


# --- metrics --------------------------------------------------------------------

_NAMED = "coalesce(nullif(service, ''), 'unspecified')"


@query("total_logs", "SELECT count(*) AS total_logs FROM events")
def _(spark, sf):
    return mt.total_logs(r.log_table(spark, sf))


@query("level_counts", f"{LOGS} SELECT level, count(*) AS n FROM logs GROUP BY level")
def _(spark, sf):
    return mt.level_counts(r.log_table(spark, sf))


@query(
    "error_rate",
    f"""{LOGS} SELECT count(*) AS total, count(*) FILTER ({ERR}) AS errors,
 round(count(*) FILTER ({ERR}) * 100e0 / count(*), 2) AS error_rate FROM logs""",
)
def _(spark, sf):
    return mt.error_rate(r.log_table(spark, sf))


@query(
    "top_services",
    f"""{UNDATED} SELECT {_NAMED} AS service, count(*) AS "count",
 round(count(*) * 100e0 / (SELECT count(*) FROM part), 1) AS percentage
 FROM part GROUP BY 1 ORDER BY count(*) DESC, min(line_number) LIMIT 10""",
)
def _(spark, sf):
    return mt.top_services(_some_undated(spark, sf))


@query(
    "top_errors",
    f"""{LOGS} SELECT substring(message, 1, 150) AS message, count(*) AS "count" FROM logs WHERE {ERR}
 GROUP BY 1 ORDER BY count(*) DESC, min(line_number) LIMIT 10""",
)
def _(spark, sf):
    return mt.top_errors(r.log_table(spark, sf))


def _in_micros(found: DataFrame) -> DataFrame:
    return found.withColumns({f"{k}_us": F.unix_micros(f"{k}_ts") for k in ("start", "end")}).drop("start_ts", "end_ts")


@query(
    "time_range",
    f"""{UNDATED} SELECT min(epoch) AS start_epoch, max(epoch) AS end_epoch,
 epoch_us(min(ts0) FILTER (epoch IS NOT NULL)) AS start_us, epoch_us(max(ts0) FILTER (epoch IS NOT NULL)) AS end_us,
 round(max(epoch) - min(epoch), 1) AS duration_seconds FROM part""",
)
def _(spark, sf):
    return _in_micros(mt.time_range(_some_undated(spark, sf)))


@query(
    "volume_histogram",
    f"""{UNDATED}, span AS (SELECT min(epoch) AS lo, greatest(1e0, (max(epoch) - min(epoch)) / 40) AS width FROM part),
 idx AS (SELECT least(CAST(floor((epoch - lo) / width) AS BIGINT), 40) AS bucket, level FROM part, span WHERE epoch IS NOT NULL)
 SELECT b.bucket, lo + b.bucket * width AS start_epoch, count(level) AS total,
 count(*) FILTER (level = 'INFO') AS "INFO", count(*) FILTER (level = 'WARN') AS "WARN",
 count(*) FILTER (level = 'ERROR') AS "ERROR", count(*) FILTER (level = 'DEBUG') AS "DEBUG", CAST(0 AS BIGINT) AS "OTHER"
 FROM (SELECT unnest(range(41)) AS bucket) b CROSS JOIN span LEFT JOIN idx ON idx.bucket = b.bucket GROUP BY 1, 2""",
)
def _(spark, sf):
    return mt.volume_histogram(_some_undated(spark, sf))


@query("affected_services", f"{UNDATED} SELECT DISTINCT service FROM part WHERE {ERR} AND service IS NOT NULL")
def _(spark, sf):
    return mt.affected_services(_some_undated(spark, sf))


@query(
    "kpi_summary",
    f"""{UNDATED} SELECT count(*) AS total_logs, count(*) FILTER ({ERR}) AS errors,
 round(count(*) FILTER ({ERR}) * 100e0 / count(*), 2) AS error_rate, count(DISTINCT {_NAMED}) AS services,
 epoch_us(min(ts0) FILTER (epoch IS NOT NULL)) AS start_us, epoch_us(max(ts0) FILTER (epoch IS NOT NULL)) AS end_us,
 round(max(epoch) - min(epoch), 1) AS duration_seconds FROM part""",
)
def _(spark, sf):
    return _in_micros(mt.kpi_summary(_some_undated(spark, sf), times=True))


# --- anomalies --------------------------------------------------------------------


def _buckets(logs: str) -> str:
    return f"""{logs}, span AS (SELECT min(epoch) AS lo, greatest(5, CAST(floor((max(epoch) - min(epoch)) / 30) AS BIGINT)) AS width FROM logs),
 rows AS (SELECT logs.*, CAST(floor((epoch - lo) / width) AS BIGINT) AS bucket FROM logs, span),
 buckets AS (SELECT bucket, count(*) AS total, count(*) FILTER ({ERR}) AS errors, count(*) FILTER (level = 'WARN') AS warnings,
  arg_min(epoch, line_number) AS start_epoch, arg_min(ts0, line_number) AS start_ts FROM rows GROUP BY bucket)"""


_BURSTS = f"""{_buckets(SPIKY)}, base AS (SELECT avg(errors) AS a, stddev_pop(errors) AS s FROM buckets),
 judged AS (SELECT *, errors / total AS rate, CASE WHEN s > 0 AND (errors - a) / s > 2 AND errors >= 3 THEN 'high'
  WHEN errors >= 3 AND errors / total > 0.6 THEN 'critical' WHEN errors >= 3 AND errors / total > 0.35 THEN 'high' END AS severity
  FROM buckets, base),
 bursts AS (SELECT * FROM judged WHERE severity IS NOT NULL)"""


def _spiky(spark, sf) -> DataFrame:
    return r.log_table(spark, sf, level=r.SPIKY_LEVEL)


def _epoch_of(ts: str, name: str):
    return (F.unix_micros(ts) / F.lit(1e6)).alias(name)


@query("anomaly_buckets", f"{_buckets(LOGS)} SELECT bucket, total, errors, warnings, start_epoch FROM buckets")
def _(spark, sf):
    b = an.anomaly_buckets(r.log_table(spark, sf))
    return b.select("bucket", "total", "errors", "warnings", _epoch_of("start_ts", "start_epoch"))


@query(
    "error_baseline",
    f"{_buckets(LOGS)} SELECT round(avg(errors), 6) AS avg_errors, round(stddev_pop(errors), 6) AS std_errors FROM buckets",
)
def _(spark, sf):
    base = an.error_baseline(an.anomaly_buckets(r.log_table(spark, sf)))
    return base.select(*[F.round(c, 6).alias(c) for c in base.columns])


@query("error_bursts", f"{_BURSTS} SELECT bucket, total, errors, round(rate, 6) AS rate, start_epoch, severity FROM bursts")
def _(spark, sf):
    b = an.error_bursts(_spiky(spark, sf))
    return b.select("bucket", "total", "errors", F.round("rate", 6).alias("rate"), _epoch_of("start_ts", "start_epoch"), "severity")


_TOP3 = f"""svc AS (SELECT bucket, service, count(*) AS n,
  row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, min(line_number)) AS rank FROM rows GROUP BY bucket, service)"""


@query("burst_services", f"{_buckets(SPIKY)}, {_TOP3} SELECT bucket, rank, service, n FROM svc WHERE rank <= 3")
def _(spark, sf):
    return an.burst_services(_spiky(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


_MSG3 = f"""msg AS (SELECT bucket, substring(message, 1, 120) AS message,
  row_number() OVER (PARTITION BY bucket ORDER BY line_number) AS rank FROM rows WHERE {ERR})"""


@query("burst_messages", f"{_buckets(LOGS)}, {_MSG3} SELECT bucket, rank, message FROM msg WHERE rank <= 3")
def _(spark, sf):
    return an.burst_messages(r.log_table(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


_HTTP = """SELECT status_code, count(*) AS n, CASE WHEN CAST(status_code AS VARCHAR) LIKE '%50%' THEN 'critical' ELSE 'high' END AS severity,
 arg_min(epoch, line_number) AS first_match FROM logs WHERE status_code >= 500 OR status_code IN (401, 403, 429)
 GROUP BY status_code HAVING count(*) >= 5"""


@query("http_outliers", f"{LOGS} SELECT CAST(status_code AS BIGINT) AS status_code, n, severity, first_match FROM ({_HTTP})")
def _(spark, sf):
    return an.http_outliers(r.log_table(spark, sf)).select(
        F.col("status_code").cast("bigint").alias("status_code"), "n", "severity", _epoch_of("first_match", "first_match")
    )


@query(
    "http_clients",
    f"""{LOGS} SELECT CAST(status_code AS BIGINT) AS status_code, client_ip, count(*) AS n FROM logs
 WHERE status_code IN (401, 403, 429) GROUP BY 1, 2""",
)
def _(spark, sf):
    return an.http_clients(r.log_table(spark, sf)).withColumn("status_code", F.col("status_code").cast("bigint"))


def _hosts(spark, sf, **options) -> DataFrame:
    """Rows of which some name a host instead of a client, or neither."""
    k = F.col("line_number") - 1
    return r.log_table(spark, sf, **options).withColumns(
        {
            "client_ip": F.when(k % 3 == 0, F.col("client_ip")),
            "host": F.when(k % 3 == 1, F.concat(F.lit("host-"), (k % 5).cast("string"))),
        }
    )


_ORIGIN = """CASE WHEN event_id % 3 = 0 THEN client_ip WHEN event_id % 3 = 1 THEN 'host-' || CAST(event_id % 5 AS VARCHAR)
 ELSE 'unknown_source' END"""
_TOLD = " OR ".join(f"contains(lower(message), '{p}')" for p in fv.AUTH_PHRASES)
_AUTH = f"""SELECT {_ORIGIN} AS auth_source, count(*) AS n, CASE WHEN count(*) >= 10 THEN 'critical' ELSE 'high' END AS severity,
 arg_min(epoch, line_number) AS first_match FROM logs WHERE {_TOLD} GROUP BY 1 HAVING count(*) >= 4"""


@query("auth_bruteforce", f"{LOGS} {_AUTH}")
def _(spark, sf):
    return an.auth_bruteforce(_hosts(spark, sf)).withColumn("first_match", _epoch_of("first_match", "first_match"))


@query(
    "rolling_error_z",
    f"""{_buckets(SPIKY)}, w AS (SELECT bucket, errors, avg(errors) OVER b AS mean, stddev_pop(errors) OVER b AS spread FROM buckets
 WINDOW b AS (ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
 SELECT bucket, errors, round(mean, 6) AS mean, round(spread, 6) AS spread,
 round(CASE WHEN spread > 0 THEN (errors - mean) / spread END, 6) AS z FROM w""",
)
def _(spark, sf):
    z = an.rolling_error_z(an.anomaly_buckets(_spiky(spark, sf)))
    return z.select("bucket", "errors", *[F.round(c, 6).alias(c) for c in ("mean", "spread", "z")])


_ISO = """strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END || '+00:00'"""
_NO_ROW = "CAST(0 AS DOUBLE)"


_EVIDENCE = f"""{_TOP3}, {_MSG3}, first AS (SELECT {_ISO.format('min(ts0)')} AS t FROM logs),
 http AS ({_HTTP}), auth AS ({_AUTH})"""
_FOUND = f"""SELECT 1 AS section, 'spike-' || CAST(bucket AS VARCHAR) AS id, 'ERROR_BURST' AS type, severity,
  printf('Sudden Error Spike (%d errors, %.1f%% error rate)', errors, round(rate * 100, 1)) AS title, {_ISO.format('start_ts')} AS timestamp, start_epoch AS first_match,
  printf('Log volume had %d events with %d errors in this window. Top affected services: %s.', total, errors,
   (SELECT string_agg(service, ', ' ORDER BY rank) FROM svc WHERE svc.bucket = bursts.bucket AND rank <= 3)) AS description,
  coalesce((SELECT string_agg(message, '|' ORDER BY rank) FROM msg WHERE msg.bucket = bursts.bucket AND rank <= 3), '') AS samples,
  errors AS metric_value, round(a, 1) AS baseline_value FROM bursts
 UNION ALL SELECT 2, 'http-HTTP ' || CAST(status_code AS VARCHAR), 'HTTP_STATUS_OUTLIER', severity,
  'High Volume of HTTP ' || CAST(status_code AS VARCHAR) || ' Responses', t, first_match,
  printf('Detected %d instances of HTTP %d responses across the logged duration.', n, status_code), '', n, 0 FROM http, first
 UNION ALL SELECT 3, 'auth-fail-' || auth_source, 'SECURITY_AUTHENTICATION_SPIKE', severity,
  printf('Possible Brute Force / Repeated Auth Failures (%d attempts)', n), t, first_match,
  printf('Target source ''%s'' recorded %d failed authentication events in the dataset.', auth_source, n), '', n, 1 FROM auth, first"""


_MINED = f"""placed AS (SELECT logs.*, id, row_number() OVER (PARTITION BY id ORDER BY line_number) AS place FROM logs JOIN run ON run.k = logs.line_number),
 mined AS (SELECT id, count(*) AS size, count(*) FILTER ({ERR}) AS error_count, {_ISO.format('arg_min(ts0, line_number)')} AS first_seen,
  string_agg(substring(message, 1, 120), '|' ORDER BY line_number) FILTER (place <= 5) AS shown, array_to_string((SELECT tpl FROM final)[id], ' ') AS template
  FROM placed GROUP BY id)"""
_RARE = """SELECT 4, 'rare-cluster-' || CAST(id AS VARCHAR), 'RARE_ERROR_TEMPLATE', 'low',
  printf('Rare Error Signature (Seen only %d time%s)', size, CASE WHEN size > 1 THEN 's' ELSE '' END), first_seen, NULL,
  'New or rare error template encountered: ''' || substring(template, 1, 100) || '''', shown, size, 0
  FROM mined WHERE error_count > 0 AND size <= 2 AND (SELECT count(*) FROM logs) > 50"""


_ALERTS = f"""{loop(r.logs_sql(level=r.SPIKY_LEVEL, message=r.RARE_MESSAGE))}, {_BURSTS.removeprefix(SPIKY + ", ")}, {_EVIDENCE}, {_MINED}"""


@query("all_anomalies", f"{_ALERTS} {_FOUND} UNION ALL {_RARE}")
def _(spark, sf):
    rows, templates = with_templates(_hosts(spark, sf, level=r.SPIKY_LEVEL, message=r.RARE_MESSAGE))
    found = an.all_anomalies(rows, templates)
    samples = F.array_join("sample_errors", "|").alias("samples")
    names = ("section", "id", "type", "severity", "title", "timestamp", "description", "metric_value", "baseline_value")
    return found.select(*names, samples, _epoch_of("first_match", "first_match"))


# --- diagnosis --------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = "rules(rule, category, pattern_no, pattern) AS (VALUES " + ", ".join(
    f"({i}, {_quoted(rule['category'])}, {j}, {_quoted('(?i)' + p)})"
    for i, rule in enumerate(fv.INCIDENT_RULES)
    for j, p in enumerate(rule["patterns"])
) + ")"
_TEXTS = "texts(rule, title, root_cause) AS (VALUES " + ", ".join(
    f"({i}, {_quoted(rule['title'])}, {_quoted(rule['root_cause'])})" for i, rule in enumerate(fv.INCIDENT_RULES)
) + ")"
_MATCHES = f"""{LOGS}, {_RULES}, {_TEXTS}, hits AS (SELECT rule, category, pattern_no, substring(pattern, 5) AS pattern, message, line_number
 FROM logs JOIN rules ON regexp_matches(message, pattern) WHERE {ERR}),
 issues AS (SELECT rule, category, count(*) AS occurrences, round(least(0.98e0, 0.6e0 + count(*) * 0.05e0), 2) AS confidence
 FROM hits GROUP BY rule, category),
 ranked AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, occurrences DESC, rule) AS rank FROM issues JOIN texts USING (rule))"""


@query("rule_matches", f"{_MATCHES} SELECT category, pattern, count(*) AS n FROM hits GROUP BY category, pattern")
def _(spark, sf):
    return dg.rule_matches(r.log_table(spark, sf)).select("category", "pattern", "n")


@query(
    "rule_matches_first_100",
    f"""{LOGS}, {_RULES}, head AS (SELECT message FROM logs WHERE {ERR} ORDER BY line_number LIMIT 100)
 SELECT category, substring(pattern, 5) AS pattern, count(*) AS n FROM head JOIN rules ON regexp_matches(message, pattern) GROUP BY 1, 2""",
)
def _(spark, sf):
    return dg.rule_matches(r.log_table(spark, sf), max_errors=100).select("category", "pattern", "n")


_STEPS = "steps(category, key, value) AS (VALUES " + ", ".join(
    f"({_quoted(rule['category'])}, '{k}', {_quoted(s)})"
    for rule in fv.INCIDENT_RULES
    for k, s in enumerate(rule["remediation"])
) + ")"


@query(
    "diagnosed_issues",
    f"""{_MATCHES}, {_STEPS} SELECT rank, category, title, confidence, occurrences, root_cause,
 (SELECT string_agg(value, '|' ORDER BY key) FROM steps WHERE steps.category = ranked.category) AS remediation FROM ranked""",
)
def _(spark, sf):
    issues = dg.diagnosed_issues(r.log_table(spark, sf)).withColumn("remediation", F.array_join("remediation", "|"))
    return issues.withColumn("rank", F.col("rank").cast("bigint"))


_SNIPPETS = """s AS (SELECT category, substring(message, 1, 200) AS snippet,
 row_number() OVER (PARTITION BY category ORDER BY pattern_no, line_number) AS rank FROM hits)"""


@query("issue_snippets", f"{_MATCHES}, {_SNIPPETS} SELECT * FROM s WHERE rank <= 3")
def _(spark, sf):
    return dg.issue_snippets(r.log_table(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


_SUMMARY = f"""SELECT printf('Analysis of %d log entries detected an active incident with %d errors (%s%% error rate). The primary suspected root cause is ''%s'' affecting services: %s. %s',
 (SELECT count(*) FROM logs), (SELECT count(*) FROM logs WHERE {ERR}),
 CAST((SELECT round(count(*) FILTER ({ERR}) * 100e0 / count(*), 2) FROM logs) AS VARCHAR), title,
 (SELECT string_agg(service, ', ' ORDER BY service) FROM (SELECT DISTINCT service FROM logs WHERE {ERR} ORDER BY service LIMIT 4)),
 root_cause) AS executive_summary FROM ranked WHERE rank = 1"""


@query("executive_summary", f"{_MATCHES} {_SUMMARY}")
def _(spark, sf):
    return dg.executive_summary(r.log_table(spark, sf))


@query(
    "evidence_sample",
    f"{LOGS} SELECT source, line_number, substring(message, 1, 250) AS sample FROM logs WHERE {ERR} ORDER BY line_number LIMIT 30",
)
def _(spark, sf):
    return dg.evidence_sample(r.log_table(spark, sf))


@query(
    "context_sample",
    f"""{LOGS} (SELECT 'errors' AS part, line_number, message FROM logs WHERE {ERR} ORDER BY line_number LIMIT 100)
 UNION ALL (SELECT 'warnings', line_number, message FROM logs WHERE level = 'WARN' ORDER BY line_number LIMIT 50)
 UNION ALL (SELECT 'rows', line_number, message FROM logs ORDER BY line_number LIMIT 50)""",
)
def _(spark, sf):
    return dg.context_sample(r.log_table(spark, sf)).select("part", "line_number", "message")


_REPORT = f"""{loop(r.logs_sql(message=r.RARE_MESSAGE))}, {_BURSTS.replace(_buckets(SPIKY), _buckets(LOGS)).removeprefix(LOGS + ", ")},
 {_EVIDENCE}, {_MINED}, {_MATCHES.removeprefix(LOGS + ", ")}, {_STEPS}, {_SNIPPETS}, alerts AS ({_FOUND} UNION ALL {_RARE})"""


@query(
    "incident_report",
    f"""{_REPORT},
 facts AS (SELECT count(*) AS total, count(*) FILTER ({ERR}) AS errors, round(count(*) FILTER ({ERR}) * 100e0 / count(*), 2) AS rate FROM logs)
 SELECT 'overview' AS section, 1 AS rank, 'total' AS key, CAST(total AS VARCHAR) AS value FROM facts
 UNION ALL SELECT 'overview', 1, 'errors', CAST(errors AS VARCHAR) FROM facts
 UNION ALL SELECT 'overview', 1, 'error_rate', CAST(rate AS VARCHAR) FROM facts
 UNION ALL SELECT 'overview', 1, 'anomalies', CAST(count(*) AS VARCHAR) FROM alerts
 UNION ALL SELECT 'summary', 1, 'executive_summary', executive_summary FROM ({_SUMMARY})
 UNION ALL SELECT 'issues', rank, 'title', title FROM ranked
 UNION ALL SELECT 'issues', rank, 'confidence', CAST(confidence AS VARCHAR) FROM ranked
 UNION ALL SELECT 'issues', rank, 'occurrences', CAST(occurrences AS VARCHAR) FROM ranked
 UNION ALL SELECT 'issues', rank, 'root_cause', root_cause FROM ranked
 UNION ALL SELECT 'remediation', rank, key, value FROM ranked JOIN steps USING (category)
 UNION ALL SELECT 'snippets', ranked.rank, CAST(s.rank - 1 AS VARCHAR), snippet FROM ranked JOIN s USING (category) WHERE s.rank <= 3
 UNION ALL SELECT 'anomalies', section, id || ' severity', severity FROM alerts
 UNION ALL SELECT 'anomalies', section, id || ' title', title FROM alerts
 UNION ALL SELECT 'anomalies', section, id || ' timestamp', timestamp FROM alerts
 UNION ALL SELECT 'anomalies', section, id || ' description', description FROM alerts""",
)
def _(spark, sf):
    rows, templates = with_templates(_hosts(spark, sf, message=r.RARE_MESSAGE))
    return dg.incident_report(rows, an.all_anomalies(rows, templates))


@query(
    "overview",
    f"""{_ALERTS}, hits AS (SELECT line_number, id FROM logs JOIN run ON run.k = logs.line_number
  WHERE level = 'ERROR' AND contains(lower(message), 'failed'))
 SELECT 'logs' AS part, CAST(line_number AS VARCHAR) AS key, id AS n FROM (SELECT * FROM hits ORDER BY line_number DESC LIMIT 20 OFFSET 5)
 UNION ALL SELECT 'total', '', count(*) FROM hits
 UNION ALL SELECT 'levels', level, count(*) FROM logs GROUP BY level
 UNION ALL SELECT 'services', service, count(*) FROM logs GROUP BY service
 UNION ALL SELECT 'templates', template, size FROM mined
 UNION ALL SELECT 'anomalies', id || ' ' || severity, metric_value FROM ({_FOUND} UNION ALL {_RARE})""",
)
def _(spark, sf):
    rows, templates = with_templates(_hosts(spark, sf, level=r.SPIKY_LEVEL, message=r.RARE_MESSAGE))
    out = new_dir(spark, "dataset")
    save_dataset(rows.select(*LOG_COLUMNS, "template_id"), out)
    view = overview(load_dataset(spark, out), templates, limit=20, offset=5, levels=["error"], query="failed")
    part = lambda name, df, key, n: df.select(F.lit(name).alias("part"), key.alias("key"), n.cast("bigint").alias("n"))
    col = F.col
    return (
        part("logs", view["logs"], col("line_number").cast("string"), col("template_id"))
        .unionByName(part("total", view["total"], F.lit(""), col(view["total"].columns[0])))
        .unionByName(part("levels", view["metrics.level_counts"], col("level"), col("n")))
        .unionByName(part("services", view["metrics.services"], col("service"), col("count")))
        .unionByName(part("templates", view["templates"], col("template"), col("size")))
        .unionByName(part("anomalies", view["anomalies"], F.concat_ws(" ", "id", "severity"), col("metric_value")))
    )
