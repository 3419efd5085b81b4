"""Error bursts, HTTP outliers, failed logins, rare errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom import fixed_values as fv
from logloom.functions.normalize import is_error, text_or_null, timestamp_text, truncate
from logloom.schema import ORDER, count_with_first
from logloom.sources.workspace import settle

ANOMALY_COLUMNS = [
    "section",
    "id",
    "type",
    "severity",
    "title",
    "timestamp",
    "first_match",
    "description",
    "sample_errors",
    "metric_value",
    "baseline_value",
]


def _bounds(*more: Column) -> list[Column]:
    """What the time buckets depend on: first time, span, dated rows."""
    return [F.min("epoch").alias("lo"), (F.max("epoch") - F.min("epoch")).alias("d"), F.count("epoch").alias("n"), *more]


def _width() -> Column:
    return F.when(F.col("d") > 0, F.greatest(F.lit(5), F.floor(F.col("d") / 30))).otherwise(60)


def _bucketed(logs: DataFrame) -> DataFrame:
    """Dated rows with their time bucket; none below five dated rows."""
    dated = logs.where(F.col("epoch").isNotNull())
    step = dated.agg(*_bounds()).select(F.struct("lo", "n", _width().alias("width"))).scalar()
    index = F.floor((F.col("epoch") - F.col("step.lo")) / F.col("step.width"))
    bucketed = dated.withColumn("step", step).where(F.col("step.n") >= fv.MIN_DATED_ROWS)
    return bucketed.withColumn("bucket", index).drop("step")


def anomaly_buckets(logs: DataFrame) -> DataFrame:
    """Rows, errors, warnings and first timestamp of each filled time bucket.

    At most some 36 buckets, whatever the size of the logs.
    """
    rows = _bucketed(logs.select("epoch", "ts", "level", *ORDER))
    level = F.col("level")
    per_source = rows.groupBy("bucket", "source").agg(
        F.count("*").alias("total"),
        F.count_if(is_error(level)).alias("errors"),
        F.count_if(level == "WARN").alias("warnings"),
        F.min_by("ts", "line_number").alias("ts"),
    )
    return _bucket_sums(per_source)


def _bucket_sums(per_source: DataFrame) -> DataFrame:
    return per_source.groupBy("bucket").agg(
        F.min_by("ts", "source").alias("start_ts"),
        *[F.sum(c).alias(c) for c in ("total", "errors", "warnings")],
    )


def error_baseline(buckets: DataFrame) -> DataFrame:
    """Mean and population deviation of errors over the filled buckets."""
    return buckets.agg(F.avg("errors").alias("avg_errors"), F.stddev_pop("errors").alias("std_errors"))


def _judged(buckets: DataFrame) -> DataFrame:
    every = W.partitionBy()  # the bucket table only: some 36 rows
    judged = buckets.withColumn("avg_errors", F.avg("errors").over(every)).withColumn(
        "std_errors", F.stddev_pop("errors").over(every)
    )
    errors, rate = F.col("errors"), F.col("errors") / F.col("total")
    enough = errors >= fv.BURST_MIN_ERRORS
    z = F.when(F.col("std_errors") > 0, (errors - F.col("avg_errors")) / F.col("std_errors"))
    severity = (
        F.when(enough & (z > fv.BURST_Z), "high")
        .when(enough & (rate > fv.BURST_CRITICAL_RATE), "critical")
        .when(enough & (rate > fv.BURST_RATE), "high")
    )
    return judged.withColumn("rate", rate).withColumn("severity", severity)


def error_bursts(logs: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """Buckets whose errors stand out from the baseline, or make up much of them."""
    judged = _judged(anomaly_buckets(logs) if buckets is None else buckets)
    return judged.where(F.col("severity").isNotNull()).select(
        "bucket", "start_ts", "total", "errors", "rate", "avg_errors", "severity"
    )


def burst_services(logs: DataFrame, n: int = 3) -> DataFrame:
    """The busiest services of each bucket, first seen on ties."""
    rows = _bucketed(logs.select("epoch", "service", *ORDER))
    named = rows.where(text_or_null(F.col("service")).isNotNull()).select("bucket", "service", *ORDER)
    return _busiest(count_with_first(named, "bucket", "service"), n)


def _busiest(counts: DataFrame, n: int) -> DataFrame:
    best = W.partitionBy("bucket").orderBy(F.desc("n"), "first_ord", "service")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select(
        "bucket", "rank", "service", "n"
    )


def burst_messages(logs: DataFrame, n: int = 3, width: int = 120) -> DataFrame:
    """The first error messages of each bucket.

    Spark keeps only ``n`` rows per bucket and task before the shuffle.
    """
    rows = _bucketed(logs.select("epoch", "level", "message", *ORDER)).where(is_error(F.col("level")))
    return _first_messages(rows, n, width)


def _first_messages(rows: DataFrame, n: int = 3, width: int = 120) -> DataFrame:
    first = W.partitionBy("bucket").orderBy(*ORDER)
    ranked = rows.select("bucket", truncate(F.col("message"), width).alias("message"), *ORDER)
    return ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).select(
        "bucket", "rank", "message"
    )


def _status_of_interest() -> Column:
    code = F.col("status_code")
    return (code >= 500) | code.isin(fv.HTTP_AUTH_CODES)


def _first_match(df: DataFrame, *keys: str) -> DataFrame:
    """Count per key and time of the key's first row."""
    per_source = df.groupBy(*keys, "source").agg(
        F.count("*").alias("n"), F.min_by("ts", "line_number").alias("ts"), F.min("line_number").alias("line_number")
    )
    return _sum_matches(per_source, *keys)


def _sum_matches(per_source: DataFrame, *keys: str) -> DataFrame:
    return per_source.groupBy(*keys).agg(F.sum("n").alias("n"), F.min_by("ts", "source").alias("first_match"))


def http_outliers(logs: DataFrame, at_least: int = fv.HTTP_MIN_ROWS) -> DataFrame:
    """Error statuses seen often."""
    rows = logs.where(_status_of_interest()).select("status_code", "ts", *ORDER)
    return _judged_statuses(_first_match(rows, "status_code"), at_least)


def _judged_statuses(counts: DataFrame, at_least: int = fv.HTTP_MIN_ROWS) -> DataFrame:
    severe = F.contains(F.col("status_code").cast("string"), F.lit("50"))
    return counts.where(F.col("n") >= at_least).select(
        "status_code", "n", F.when(severe, "critical").otherwise("high").alias("severity"), "first_match"
    )


def http_clients(logs: DataFrame) -> DataFrame:
    """Refused requests per status and client."""
    refused = F.col("status_code").isin(fv.HTTP_AUTH_CODES) & text_or_null(F.col("client_ip")).isNotNull()
    return logs.where(refused).groupBy("status_code", "client_ip").agg(F.count("*").alias("n"))


def tells_auth_failure() -> Column:
    return F.coalesce(F.lower("message").rlike("|".join(fv.AUTH_PHRASES)), F.lit(False))


def auth_origin() -> Column:
    """Where a login came from: client, else host."""
    return F.coalesce(text_or_null(F.col("client_ip")), text_or_null(F.col("host")), F.lit("unknown_source"))


def auth_failures(logs: DataFrame) -> DataFrame:
    """Rows that tell of a failed login, with the source they came from."""
    return logs.where(tells_auth_failure()).withColumn("auth_source", auth_origin())


def _auth_severity() -> Column:
    return F.when(F.col("n") >= fv.AUTH_CRITICAL_ROWS, "critical").otherwise("high")


def auth_bruteforce(logs: DataFrame, at_least: int = fv.AUTH_MIN_ROWS) -> DataFrame:
    """Sources of many failed logins."""
    rows = auth_failures(logs).select("auth_source", "ts", *ORDER)
    return _judged_logins(_first_match(rows, "auth_source"), at_least)


def _judged_logins(counts: DataFrame, at_least: int = fv.AUTH_MIN_ROWS) -> DataFrame:
    return counts.where(F.col("n") >= at_least).select(
        "auth_source", "n", _auth_severity().alias("severity"), "first_match"
    )


def rare_templates(templates: DataFrame, logs: DataFrame) -> DataFrame:
    """Templates with an error that were seen once or twice, in sets above 50 rows."""
    return _rare(templates, logs.agg(F.count("*")).scalar())


def _rare(templates: DataFrame, total: Column) -> DataFrame:
    rare = (F.col("error_count") > 0) & (F.col("size") <= fv.RARE_MAX_SIZE)
    return templates.where(rare).where(F.lit(total) > fv.RARE_MIN_TOTAL)


# What one scan counts for all findings: kinds of (number, name) keys.
_BUCKET, _SERVICE, _STATUS, _LOGIN = 1, 2, 3, 4


def _facts(logs: DataFrame, index: Column, bucketed: bool) -> DataFrame:
    """``kind, number, name, source`` with rows, errors, warnings and the first
    place and time: buckets, services of buckets, statuses, failed logins.

    A row has one to four keys and is counted for each before the shuffle, in
    buffers of fixed width.
    """
    service = text_or_null(F.col("service"))
    none, nothing = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    key = lambda when, kind, number, name: F.when(when, F.struct(F.lit(kind).alias("kind"), number.alias("number"), name.alias("name")))
    dated = F.col("epoch").isNotNull() & F.lit(bucketed)
    keys = F.array_compact(
        F.array(
            key(dated, _BUCKET, index, nothing),
            key(dated & service.isNotNull(), _SERVICE, index, service),
            key(_status_of_interest(), _STATUS, F.col("status_code").cast("bigint"), nothing),
            key(tells_auth_failure(), _LOGIN, none, auth_origin()),
        )
    )
    level = F.col("level")
    rows = logs.select("ts", "level", *ORDER, F.inline(keys))
    return rows.groupBy("kind", "number", "name", "source").agg(
        F.count("*").alias("n"),
        F.count_if(is_error(level)).alias("errors"),
        F.count_if(level == "WARN").alias("warnings"),
        F.min_by("ts", "line_number").alias("ts"),
        F.min("line_number").alias("line_number"),
    )


def rolling_error_z(buckets: DataFrame, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """Deviation of each bucket's errors from the ``n`` buckets before it."""
    before = W.partitionBy(*(by or [])).orderBy("bucket").rowsBetween(-n, -1)
    mean, spread = F.avg("errors").over(before), F.stddev_pop("errors").over(before)
    z = F.when(spread > 0, (F.col("errors") - mean) / spread)
    return buckets.select(*(by or []), "bucket", "errors", mean.alias("mean"), spread.alias("spread"), z.alias("z"))


def all_anomalies(logs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """All findings in one table: bursts, HTTP, logins, then rare templates.

    ``templates`` needs template_id, template, size, error_count, first_seen
    and samples (messages). ``timestamp`` of HTTP and login findings is that
    of the first row of the logs; ``first_match`` is that of the finding.
    """
    none, no_time = F.array().cast("array<string>"), F.lit(None).cast("timestamp")

    def shape(df: DataFrame, **c: Column) -> DataFrame:
        return df.select(*[c[name].alias(name) for name in ANOMALY_COLUMNS])

    # Three scans: bounds, all counts, and the messages of the bursts found.
    first = F.min_by(timestamp_text(F.col("ts"), F.col("ts_raw")), F.struct(*ORDER)).alias("first")
    bounds = logs.agg(*_bounds(F.count("*").alias("total"), first)).withColumn("width", _width()).first()
    first_row = F.lit(bounds["first"]).cast("string")
    index = F.floor((F.col("epoch") - F.lit(bounds["lo"])) / F.lit(bounds["width"])).cast("bigint")
    facts = settle(_facts(logs, index, bounds["n"] >= fv.MIN_DATED_ROWS))
    of = lambda kind, *names: facts.where(F.col("kind") == kind).select(*names, "source", "n", "errors", "warnings", "ts", "line_number")
    number = lambda name: F.col("number").alias(name)
    bursts = settle(error_bursts(logs, _bucket_sums(of(_BUCKET, number("bucket")).withColumnRenamed("n", "total"))))
    counts = of(_SERVICE, number("bucket"), F.col("name").alias("service")).groupBy("bucket", "service")
    counts = counts.agg(F.sum("n").alias("n"), F.min(F.struct(*ORDER)).alias("first_ord"))
    services = _busiest(counts.join(bursts.select("bucket"), "bucket", "left_semi"), 3).groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("rank", "service")))["service"].alias("services")
    )
    at = [r.bucket for r in bursts.select("bucket").collect()]  # some 36 at most
    wanted = logs.select("epoch", "level", "message", *ORDER, index.alias("bucket")).where(F.col("bucket").isin(at) & is_error(F.col("level")))
    messages = _first_messages(wanted).groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("rank", "message")))["message"].alias("messages")
    )
    # Both hold three values per bucket, some 36 rows in all.
    bursts = bursts.join(F.broadcast(services), "bucket", "left").join(F.broadcast(messages), "bucket", "left")
    errors, total = F.col("errors"), F.col("total")
    start = timestamp_text(F.col("start_ts"), F.lit(None).cast("string"))
    named = F.coalesce(F.array_join("services", ", "), F.lit("N/A"))
    parts = [
        shape(
            bursts,
            section=F.lit(1),
            id=F.concat(F.lit("spike-"), F.col("bucket").cast("string")),
            type=F.lit("ERROR_BURST"),
            severity=F.col("severity"),
            title=F.format_string(fv.BURST_TITLE, errors, F.round(F.col("rate") * 100, 1)),
            timestamp=start,
            first_match=F.col("start_ts"),
            description=F.format_string(fv.BURST_TEXT, total, errors, named),
            sample_errors=F.coalesce("messages", none),
            metric_value=errors.cast("bigint"),
            baseline_value=F.round("avg_errors", 1),
        )
    ]
    code, n = F.col("status_code"), F.col("n")
    parts.append(
        shape(
            _judged_statuses(_sum_matches(of(_STATUS, number("status_code")), "status_code")),
            section=F.lit(2),
            id=F.concat(F.lit("http-HTTP "), code.cast("string")),
            type=F.lit("HTTP_STATUS_OUTLIER"),
            severity=F.col("severity"),
            title=F.format_string(fv.HTTP_TITLE, code),
            timestamp=first_row,
            first_match=F.col("first_match"),
            description=F.format_string(fv.HTTP_TEXT, n, code),
            sample_errors=none,
            metric_value=n,
            baseline_value=F.lit(0.0),
        )
    )
    origin = F.col("auth_source")
    parts.append(
        shape(
            _judged_logins(_sum_matches(of(_LOGIN, F.col("name").alias("auth_source")), "auth_source")),
            section=F.lit(3),
            id=F.concat(F.lit("auth-fail-"), origin),
            type=F.lit("SECURITY_AUTHENTICATION_SPIKE"),
            severity=F.col("severity"),
            title=F.format_string(fv.AUTH_TITLE, n),
            timestamp=first_row,
            first_match=F.col("first_match"),
            description=F.format_string(fv.AUTH_TEXT, origin, n),
            sample_errors=none,
            metric_value=n,
            baseline_value=F.lit(1.0),
        )
    )
    if templates is not None:
        size = F.col("size")
        parts.append(
            shape(
                _rare(templates, F.lit(bounds["total"])),
                section=F.lit(4),
                id=F.concat(F.lit("rare-cluster-"), F.col("template_id").cast("string")),
                type=F.lit("RARE_ERROR_TEMPLATE"),
                severity=F.lit("low"),
                title=F.format_string(fv.RARE_TITLE, size, F.when(size > 1, "s").otherwise("")),
                timestamp=F.col("first_seen"),
                first_match=no_time,
                description=F.format_string(fv.RARE_TEXT, truncate(F.col("template"), 100)),
                sample_errors=F.transform("samples", lambda m: truncate(m, 120)),
                metric_value=size,
                baseline_value=F.lit(0.0),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
