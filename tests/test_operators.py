"""Filters, metrics, anomalies, diagnosis, sources and sinks on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from checks import render as r
from checks.catalog import QUERIES
from logloom import fixed_values as fv
from logloom.functions import normalize as nz
from logloom.operators import anomalies as an
from logloom.operators import diagnostics as dg
from logloom.operators import filters as fl
from logloom.operators import metrics as mt
from logloom.operators import templates as tm
from logloom.plans import overview as ov
from logloom.sources import workspace
from logloom.schema import LOG_SCHEMA
from logloom.sources import datasets as ds
from logloom.sources.text import decode_lines, read_log_lines, require_lines
from logloom.sources.workspace import new_dir

FIELDS = "line_number long, epoch double, level string, service string, message string, status_code int, client_ip string, host string"


@pytest.fixture
def logs_of(spark):
    def build(rows, source="s"):
        """Rows of (epoch, level, service, message[, status, ip, host])."""
        full = [(i, *r, *[None] * (7 - len(r))) for i, r in enumerate(rows, 1)]
        df = spark.createDataFrame(full, FIELDS).withColumn("source", F.lit(source))
        df = df.withColumn("ts", F.timestamp_micros((F.col("epoch") * 1e6).cast("long"))).withColumn("raw", F.col("message"))
        columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA]
        return df.select(*columns).repartition(5)

    return build


def rows(df, *columns):
    return sorted(tuple(x) for x in (df.select(*columns) if columns else df).collect())


# --- normalisers -----------------------------------------------------------------


@pytest.mark.parametrize("level, words", fv.LEVEL_WORDS.items())
def test_level_words(spark, level, words):
    df = spark.createDataFrame([(f" {w.lower()}\t",) for w in words], "w string")
    assert {x[0] for x in df.select(nz.normalize_level(F.col("w"))).collect()} == {level}


def test_level_of_unknown_words(spark):
    df = spark.createDataFrame([("what",), ("",), (None,), ("50",)], "w string")
    assert {x[0] for x in df.select(nz.normalize_level(F.col("w"))).collect()} == {"INFO"}
    assert [x[0] for x in df.select(nz.normalize_level(F.col("w"), numeric=True)).collect()] == ["INFO"] * 3 + ["ERROR"]


@pytest.mark.parametrize(
    "text, epoch",
    [
        ("2026-10-02T00:30:15Z", 1790901015.0),
        ("2026-10-02T00:30:15.1234567Z", 1790901015.123456),
        ("[2026-10-02 00:30:15,123]", 1790901015.123),
        ("2026-10-02T02:30:15+0200", 1790901015.0),
        ("2026-10-01 19:00:15-05:30", 1790901015.0),
        ("2026-10-02T00:30", 1790901000.0),
        ("2026-10-02", 1790899200.0),
        ("20261002T003015", 1790901015.0),
        ("02/Oct/2026:00:30:15 +0000", 1790901015.0),
        ("Oct  2 00:30:15", 1790901015.0),
        ("oct 02 00:30:15", 1790901015.0),
        ("2026-13-02T00:30:15Z", None),
        ("31/Feb/2026:00:30:15 +0000", None),
        ("12:30:15", None),
        ("2026/10/02 00:30:15", None),
        ("1790901015", None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_timestamps(spark, text, epoch, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = spark.createDataFrame([(text,)], "t string").select(nz.parse_timestamp(F.col("t"), 2026).alias("t")).first().t
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (t.epoch, t.ts_raw) == (epoch, None if epoch else text)


# --- filters ---------------------------------------------------------------------


def test_filters(logs_of):
    logs = logs_of([(1.0, "ERROR", "a", "Big BANG"), (2.0, "WARN", "", "b"), (None, "INFO", None, "x.y"), (3.0, "CRITICAL", "A", "xzy")])
    found = lambda **f: [x[0] for x in rows(fl.filter_logs(logs, **f), "line_number")]
    assert found(levels=["error", "warn"]) == [1, 2]
    assert found(services=["a"]) == [1]
    assert found(services=["unspecified"]) == [2, 3]
    assert found(services=["A", "unspecified"]) == [2, 3, 4]
    assert found(start_epoch=2) == [2, 3, 4]
    assert found(start_epoch=1, end_epoch=2, keep_undated=False) == [1, 2]
    assert found(query="bang") == [1]
    assert found(query="X.Y") == [3]
    assert found(query="X.Y", is_regex=True) == [3, 4]
    assert [x[0] for x in rows(fl.errors_only(logs), "line_number")] == [1]
    with pytest.warns(UserWarning):
        assert found(query="x.y(", is_regex=True) == []


def test_day_folders_are_pruned(spark, logs_of):
    logs = logs_of([(i * 43_200.0, "INFO", "a", "m") for i in range(10)] + [(None, "INFO", "a", "m")])
    path = new_dir(spark, "days")
    ds.save_dataset(logs, path)
    stored = ds.load_dataset(spark, path)
    assert rows(stored, "line_number", "message", "epoch") == rows(logs, "line_number", "message", "epoch")
    some = fl.filter_logs(stored, start_epoch=90_000, end_epoch=180_000)
    assert [x[0] for x in rows(some, "line_number")] == [4, 5, 11]
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in scan and "day" in scan.split("PartitionFilters")[1]


def test_pages_follow_each_other(logs_of):
    logs = logs_of([(float(i), "INFO", "a", str(i)) for i in range(25)])
    by_offset = [x.line_number for k in range(3) for x in fl.page_logs(logs, 10, 10 * k).collect()]
    by_key, last = [], None
    for _ in range(3):
        page = fl.page_after(logs, last, 10).collect()
        by_key += [x.line_number for x in page]
        last = ("s", page[-1].line_number)
    assert by_offset == by_key == list(range(25, 0, -1))
    assert [x.line_number for x in fl.sort_logs(logs, "time", False).collect()] == list(range(1, 26))


# --- metrics ---------------------------------------------------------------------


def test_metrics_of_nothing(logs_of):
    logs = logs_of([])
    assert rows(mt.total_logs(logs)) == [(0,)]
    assert rows(mt.error_rate(logs)) == [(0, 0, 0.0)]
    for df in (mt.level_counts(logs), mt.top_services(logs), mt.top_errors(logs), mt.volume_histogram(logs), an.all_anomalies(logs)):
        assert df.count() == 0
    assert rows(mt.time_range(logs)) == [(None, None, None, None, 0.0)]
    assert rows(mt.kpi_summary(logs)) == [(0, 0, 0.0, 0, 0.0)]
    assert dg.diagnosed_issues(logs).count() == 0
    assert "No critical errors" in dg.executive_summary(logs).first()[0]
    assert tm.mine_templates(logs).latest().count() == 0


def test_kpi_summary_tells_first_and_last_time(spark, logs_of):
    logs = logs_of([(5.0, "INFO", "a", "m"), (2.0, "ERROR", "b", "m"), (None, "INFO", None, "m"), (9.5, "INFO", "a", "m")])
    found = mt.kpi_summary(logs, times=True).first()
    assert (found.start_ts.timestamp(), found.end_ts.timestamp()) == (2.0, 9.5)
    assert (found.total_logs, found.errors, found.error_rate, found.services, found.duration_seconds) == (4, 1, 25.0, 3, 7.5)
    folder = new_dir(spark, "tables")
    rows = spark.range(20).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts", "id AS user_id",
        "'view' AS event_type", "1.0D AS value", "'{}' AS props",
    )
    rows.write.parquet(f"{folder}/events.parquet")
    found, start = QUERIES["kpi_summary"](spark, folder).first(), 1_704_067_200_000_000
    assert (found.start_us, found.end_us) == (start + 60_000_000, start + 19 * 60_000_000)  # every ninth row has no time


def test_histogram_levels_and_single_time(logs_of):
    logs = logs_of([(5.0, x, "a", "m") for x in ("CRITICAL", "TRACE", "ERROR", "INFO", "WARN", "DEBUG")])
    hist = mt.volume_histogram(logs).orderBy("bucket").collect()
    assert len(hist) == 41 and hist[1].start_epoch == 6.0
    assert tuple(hist[0])[1:] == (5.0, 6, 1, 1, 2, 1, 1) and sum(x.total for x in hist) == 6


def test_tops_break_ties_by_first_place(logs_of):
    logs = logs_of([(1.0, "ERROR", s, m) for s, m in [("z", "q"), ("a", "p"), ("a", "q"), ("z", "p"), (None, "r" * 200)]])
    assert [tuple(x) for x in mt.top_services(logs).collect()] == [("z", 2, 40.0), ("a", 2, 40.0), ("unspecified", 1, 20.0)]
    assert [tuple(x) for x in mt.top_errors(logs).collect()] == [("q", 2), ("p", 2), ("r" * 150, 1)]


# --- anomalies --------------------------------------------------------------------


def test_burst_by_deviation_and_by_rate(logs_of):
    calm = [(60.0 * i, "INFO", "a", "ok") for i in range(100)]
    spike = [(3000.0 + i, "ERROR", "b" if i % 2 else "c", f"bad {i}") for i in range(20)]
    found = an.error_bursts(logs_of(calm + spike)).collect()
    assert [(x.errors, x.severity) for x in found] == [(20, "high")]
    every = an.all_anomalies(logs_of(calm + spike)).where("type = 'ERROR_BURST'").first()
    assert every.sample_errors == ["bad 0", "bad 1", "bad 2"] and "Top affected services: c, b, a." in every.description
    even = an.error_bursts(logs_of([(float(i), "ERROR" if i % 3 else "INFO", "a", "m") for i in range(90)])).collect()
    assert {(x.errors, x.total, x.severity) for x in even} == {(3, 5, "high"), (4, 5, "critical")}
    assert an.error_bursts(logs_of([(1.0, "ERROR", "a", "m")] * 4)).count() == 0  # fewer than five rows


def test_http_and_login_rules(logs_of):
    data = [(1.0, "ERROR", "w", "m", 550)] * 5 + [(2.0, "ERROR", "w", "m", 511)] * 5 + [(3.0, "WARN", "w", "m", 401, "1.1.1.1")] * 4
    data += [(4.0, "WARN", "w", "Login FAILED", None, "2.2.2.2", "h")] * 4 + [(5.0, "WARN", "w", "x unauthorized", None, None, "h")] * 10
    data += [(6.0, "WARN", "w", "failed password")] * 3
    logs = logs_of(data)
    assert rows(an.http_outliers(logs), "status_code", "n", "severity") == [(511, 5, "high"), (550, 5, "critical")]
    assert rows(an.http_clients(logs)) == [(401, "1.1.1.1", 4)]
    assert rows(an.auth_bruteforce(logs), "auth_source", "n", "severity") == [("2.2.2.2", 4, "high"), ("h", 10, "critical")]
    assert an.all_anomalies(logs).where("section = 3").first().timestamp == "1970-01-01T00:00:01+00:00"


def test_rare_templates_need_more_than_fifty_rows(logs_of):
    data = [(float(i), "INFO", "a", "all is well here") for i in range(50)] + [(99.0, "ERROR", "a", "odd thing")]
    for n, want in ((51, ["odd thing"]), (50, [])):
        logs = logs_of(data[51 - n :])
        assigned, templates = ov.with_templates(logs)
        found = an.all_anomalies(logs, templates).where("section = 4").collect()
        assert [x.sample_errors for x in found] == [[m] for m in want]
        if want:
            assert found[0].title == "Rare Error Signature (Seen only 1 time)" and found[0].metric_value == 1


def test_findings_take_three_scans_and_the_report_three_more(spark, logs_of):
    data = [(60.0 * i, "INFO", "a", "ok") for i in range(100)] + [(3000.0 + i, "ERROR", "b", "Connection refused by db", 503) for i in range(20)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = logs_of(data)
    logs = plain.mapInArrow(counted, plain.schema)
    found = an.all_anomalies(logs)
    assert {r.section for r in found.collect()} == {1, 2} and seen.value == 3 * len(data)
    report = dg.incident_report(logs, found)
    sections = {r.section for r in report.collect()}
    assert {"overview", "summary", "issues", "snippets", "remediation", "anomalies"} == sections and seen.value <= 7 * len(data)
    shown = dg.issues_with_snippets(plain).where("rank = 1").first()
    assert shown.snippets == ["Connection refused by db"] * 3


# --- diagnosis --------------------------------------------------------------------


def test_rules(logs_of):
    logs = logs_of([(1.0, "ERROR", "db", "Connection REFUSED: pool exhausted")] * 3 + [(2.0, "CRITICAL", "x", "OOMKilled")] + [(3.0, "INFO", "i", "deadlock")])
    assert rows(dg.rule_matches(logs), "category", "pattern", "n") == [
        ("DATABASE_FAILURE", "connection refused", 3),
        ("DATABASE_FAILURE", "pool exhausted", 3),
        ("MEMORY_EXHAUSTION", "oomkilled", 1),
    ]
    issues = dg.diagnosed_issues(logs).orderBy("rank").collect()
    assert [(x.category, x.confidence, x.occurrences) for x in issues] == [("DATABASE_FAILURE", 0.9, 6), ("MEMORY_EXHAUSTION", 0.65, 1)]
    assert issues[0].remediation == fv.INCIDENT_RULES[0]["remediation"]
    assert rows(dg.issue_snippets(logs), "category", "rank").count(("DATABASE_FAILURE", 3)) == 1
    assert "services: db, x." in dg.executive_summary(logs).first()[0]
    assert rows(dg.rule_matches(logs, max_errors=1), "n") == [(1,), (1,)]
    own = [{"category": "C", "patterns": ["refused"], "title": "t", "root_cause": "r", "remediation": ["do"]}]
    assert [(x.category, x.occurrences) for x in dg.diagnosed_issues(logs, own).collect()] == [("C", 3)]


def test_summary_of_other_errors(logs_of):
    text = dg.executive_summary(logs_of([(1.0, "ERROR", "a", "odd"), (1.0, "INFO", "a", "m")])).first()[0]
    assert text.startswith("Detected 1 errors (50.0% error rate) across 1 services.")


def test_rules_table_has_a_row_per_pattern(spark):
    assert dg.rules_table(spark).count() == sum(len(x["patterns"]) for x in fv.INCIDENT_RULES)


# --- sources, sinks, plans ------------------------------------------------------------


def test_latin1_is_decided_per_source(lines_of):
    a = lines_of(["caf", "x"], "a").withColumn("line", F.expr("cast(concat(encode(line, 'utf-8'), X'E9') as string)"))
    b = lines_of(["Ã©", "é"], "b")
    got = rows(decode_lines(a.unionByName(b)), "source", "line")
    assert got == [("a", "café"), ("a", "xé"), ("b", "Ã©"), ("b", "é")]


def test_empty_input_is_refused(spark):
    path = new_dir(spark, "empty")
    spark.createDataFrame([], "v string").write.text(path)
    with pytest.raises(ValueError):
        require_lines(read_log_lines(spark, path))


def test_exports_in_order_with_limit(spark, logs_of):
    logs = logs_of([(float(i), "INFO", None, f'a "{i}",\nb') for i in range(30)])
    path = new_dir(spark, "csv")
    ds.write_csv(logs, path, limit=10)
    lines = [x.value for x in spark.read.text(path, wholetext=True).collect()]
    start = "Timestamp,Level,Service,Message,Source,Line\n1970-01-01T00:00:00+00:00,INFO,,"
    assert any(text.startswith(start) for text in lines)
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert rows(got, "Line", "Message")[0] == ("1", 'a "0",\nb') and got.count() == 10


def test_overview_and_ingest(spark):
    path = r.text_files(spark, "/root/testdata/sf0.001", r.json_line())
    out = new_dir(spark, "stored")
    logs = ov.ingest(spark, f"{path}/*", out)
    assert logs.count() == 1000 and logs.select("id").distinct().count() == 1000
    made = len(workspace._made)
    parts = ov.overview(logs, ov.load_templates(spark, out), limit=20, levels=["error"])
    assert parts["logs"].count() == 20
    assert parts["total"].first()[0] == logs.where("level = 'ERROR'").count()
    templates = {t.template_id: t for t in parts["templates"].collect()}
    assert sum(t.size for t in templates.values()) == 1000
    assert parts["anomalies"].count() > 0 and parts["metrics.histogram"].count() == 41
    assert len(workspace._made) == made  # nothing was written
    some = max(templates)
    page = ov.overview(logs, parts["templates"], template_id=some)
    assert page["total"].first()[0] == templates[some].size == logs.where(F.col("template_id") == some).count()
    workspace.clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(out)


# --- partitions and plans ---------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_results_do_not_depend_on_partitions(spark, parts):
    base = r.log_table(spark, "/root/testdata/sf0.001", message=r.NAMED_MESSAGE)
    logs = base.repartition(parts, "message")
    for run in (
        lambda d: mt.top_services(d),
        lambda d: mt.volume_histogram(d),
        lambda d: tm.signature_counts(d).drop("first_ord"),
        lambda d: an.all_anomalies(d).withColumn("sample_errors", F.array_join("sample_errors", "|")),
        lambda d: tm.mine_templates(d).latest().select("template_id", "template"),
        lambda d: dg.issue_snippets(d),
    ):
        assert sorted(map(repr, run(logs).collect())) == sorted(map(repr, run(base).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    logs = r.log_table(spark, "/root/testdata/sf0.001")
    counts = plan(mt.top_services(logs))
    assert "SortAggregate" not in counts.split("Exchange")[-1]  # rows are hashed, not sorted
    for limited in (an.burst_messages(logs), dg.issue_snippets(logs), tm.first_rows(logs, "service")):
        assert plan(limited).count("WindowGroupLimit") >= 2  # cut before and after the shuffle
    for df in (mt.error_rate(logs), mt.level_counts(logs), dg.rule_matches(logs), tm.signature_counts(logs)):
        text = plan(df)
        assert "partial_count" in text and "Python" not in text and "CartesianProduct" not in text
    assert "NestedLoop" not in plan(mt.volume_histogram(logs))


def _plan(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_times_are_written_once(spark):
    """Each step stands once in the plan; as one expression its code went beyond 64 KB."""
    assert _plan(spark, "parse_timestamp").count("HH:mm:ss,SSS") == 1


def test_messages_are_masked_once(spark):
    assert _plan(spark, "template_text").count("<UUID>") == 1
