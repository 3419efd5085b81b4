"""Diagnosis of incidents by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom import fixed_values as fv
from logloom.functions.normalize import is_error, truncate
from logloom.operators.metrics import affected_services, error_rate, rate_columns
from logloom.schema import ORDER
from logloom.sources.workspace import settle

RULES = fv.INCIDENT_RULES


def rules_table(spark: SparkSession, rules: list[dict] = RULES) -> DataFrame:
    """The rules as rows, one per pattern; a copy with other rows is a valid rule set."""
    rows = [
        (i, r["category"], j, p, r["title"], r["root_cause"], r["remediation"])
        for i, r in enumerate(rules)
        for j, p in enumerate(r["patterns"])
    ]
    schema = (
        "rule int, category string, pattern_no int, pattern string, title string, "
        "root_cause string, remediation array<string>"
    )
    return spark.createDataFrame(rows, schema)


def _errors(logs: DataFrame, max_errors: int | None) -> DataFrame:
    errors = logs.where(is_error(F.col("level")))
    return errors if max_errors is None else errors.orderBy(*ORDER).limit(max_errors)


def _hit(pattern: str) -> Column:
    return F.coalesce(F.col("message").rlike(f"(?i){pattern}"), F.lit(False))


def _patterns(rules: list[dict]) -> list[tuple[int, dict, int, str]]:
    return [(i, r, j, p) for i, r in enumerate(rules) for j, p in enumerate(r["patterns"])]


def _counters(rules: list[dict], among: Column | None = None) -> list[Column]:
    hit = lambda p: _hit(p) if among is None else among & _hit(p)
    return [F.count_if(hit(p)).alias(f"c{k}") for k, (*_, p) in enumerate(_patterns(rules))]


def _as_matches(counts: DataFrame, rules: list[dict]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("rule"),
            F.lit(r["category"]).alias("category"),
            F.lit(j).alias("pattern_no"),
            F.lit(p).alias("pattern"),
            F.col(f"c{k}").alias("n"),
        )
        for k, (i, r, j, p) in enumerate(_patterns(rules))
    ]
    return counts.select(F.inline(F.array(*rows))).where(F.col("n") > 0)


def rule_matches(logs: DataFrame, rules: list[dict] = RULES, max_errors: int | None = None) -> DataFrame:
    """How many error messages each pattern is found in.

    One pass: every pattern is a counter of the same aggregation, so only one
    row per task is shuffled. ``max_errors=100`` looks at the first 100 only.
    """
    return _as_matches(_errors(logs, max_errors).agg(*_counters(rules)), rules)


def diagnosed_issues(logs: DataFrame, rules: list[dict] = RULES, max_errors: int | None = None) -> DataFrame:
    """Categories with a match, most certain first: rank, confidence, texts."""
    return _as_issues(rule_matches(logs, rules, max_errors), rules)


def _as_issues(matches: DataFrame, rules: list[dict]) -> DataFrame:
    found = matches.groupBy("rule", "category").agg(F.sum("n").alias("occurrences"))
    scaled = fv.CONFIDENCE_BASE + F.col("occurrences") * fv.CONFIDENCE_STEP
    confidence = F.round(F.least(F.lit(fv.CONFIDENCE_MAX), scaled), 2)
    best = W.partitionBy().orderBy(F.desc("confidence"), F.desc("occurrences"), "rule")  # one row per rule
    text = lambda key: F.element_at(F.array(*[F.lit(r[key]) for r in rules]), F.col("rule") + 1)
    steps = F.element_at(
        F.array(*[F.array(*[F.lit(s) for s in r["remediation"]]) for r in rules]), F.col("rule") + 1
    )
    return found.withColumn("confidence", confidence).select(
        F.row_number().over(best).alias("rank"),
        "category",
        text("title").alias("title"),
        "confidence",
        "occurrences",
        text("root_cause").alias("root_cause"),
        steps.alias("remediation"),
    )


def issues_with_snippets(logs: DataFrame, rules: list[dict] = RULES, max_errors: int | None = None, n: int = 3) -> DataFrame:
    """Diagnosed issues, each with its first matching messages."""
    return _with_snippets(diagnosed_issues(logs, rules, max_errors), issue_snippets(logs, rules, max_errors, n))


def _with_snippets(issues: DataFrame, snippets: DataFrame) -> DataFrame:
    shown = snippets.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("rank", "snippet")))["snippet"].alias("snippets"))
    return issues.join(F.broadcast(shown), "category", "left")  # a few rows per rule


def issue_snippets(
    logs: DataFrame, rules: list[dict] = RULES, max_errors: int | None = None, n: int = 3, width: int = 200
) -> DataFrame:
    """The first matching messages of each category, in pattern then row order."""
    hits = [
        F.when(_hit(p), F.struct(F.lit(r["category"]).alias("category"), F.lit(j).alias("pattern_no")))
        for r in rules
        for j, p in enumerate(r["patterns"])
    ]
    matched = _errors(logs, max_errors).select("message", *ORDER, F.inline(F.array_compact(F.array(*hits))))
    first = W.partitionBy("category").orderBy("pattern_no", *ORDER)
    ranked = matched.withColumn("message", truncate(F.col("message"), width))
    return ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).select(
        "category", "rank", F.col("message").alias("snippet")
    )


def executive_summary(logs: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """The state of the logs in one sentence: issue found, errors only, or clean."""
    return _summary(error_rate(logs), diagnosed_issues(logs) if issues is None else issues, settle(affected_services(logs)))


def _summary(facts: DataFrame, issues: DataFrame, services: DataFrame) -> DataFrame:
    primary = issues.where(F.col("rank") == 1).select(F.struct("title", "root_cause")).scalar()
    named = services.orderBy("service").limit(4).agg(F.array_join(F.sort_array(F.collect_list("service")), ", "))
    facts = facts.withColumns(
        {"primary": primary, "named": named.scalar(), "n_services": services.agg(F.count("*")).scalar()}
    )
    total, errors, rate = F.col("total"), F.col("errors"), F.col("error_rate").cast("string")
    who = F.coalesce(F.nullif(F.col("named"), F.lit("")), F.lit("unknown"))
    issue = F.format_string(
        fv.SUMMARY_ISSUE, total, errors, rate, F.col("primary.title"), who, F.col("primary.root_cause")
    )
    return facts.select(
        F.when(F.col("primary").isNotNull(), issue)
        .when(errors > 0, F.format_string(fv.SUMMARY_ERRORS, errors, rate, F.col("n_services")))
        .otherwise(F.format_string(fv.SUMMARY_CLEAN, total))
        .alias("executive_summary")
    )


def evidence_sample(logs: DataFrame, n_errors: int = 30, width: int = 250) -> DataFrame:
    """The first error lines, cut, for a reader who wants proof."""
    text = F.coalesce(F.nullif(F.col("raw"), F.lit("")), "message")
    return _errors(logs, n_errors).select(*ORDER, truncate(text, width).alias("sample"))


def context_sample(logs: DataFrame, errors: int = 100, warnings: int = 50, rows: int = 50) -> DataFrame:
    """First errors, first warnings and first rows of any level, one after another."""
    head = lambda df, part, n: df.orderBy(*ORDER).limit(n).withColumn("part", F.lit(part))
    return (
        head(logs.where(is_error(F.col("level"))), "errors", errors)
        .unionByName(head(logs.where(F.col("level") == "WARN"), "warnings", warnings))
        .unionByName(head(logs, "rows", rows))
    )


def incident_report(logs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Report as a long table (section, rank, key, value).

    Three scans besides those of the anomalies: totals with all rules, the
    services with errors, and the snippets of the issues found.
    """
    anomalies, failed = settle(anomalies), is_error(F.col("level"))
    counted = settle(logs.agg(*rate_columns(), *_counters(RULES, failed)))
    issues = settle(_with_snippets(_as_issues(_as_matches(counted, RULES), RULES), issue_snippets(logs)))
    totals = counted.select("total", "errors", "error_rate")
    facts = totals.withColumn("anomalies", anomalies.agg(F.count("*")).scalar())

    def rows(df: DataFrame, section: str, rank: Column, *pairs: tuple[Column, Column]) -> DataFrame:
        entries = F.array(*[F.struct(k.alias("key"), v.cast("string").alias("value")) for k, v in pairs])
        return df.select(F.lit(section).alias("section"), rank.cast("int").alias("rank"), F.inline(entries))

    head = [(F.lit(name), F.col(name)) for name in ("total", "errors", "error_rate", "anomalies")]
    summary = _summary(totals, issues, settle(affected_services(logs)))
    found = [(F.lit(name), F.col(name)) for name in ("title", "confidence", "occurrences", "root_cause")]
    alerts = [(F.concat_ws(" ", "id", F.lit(name)), F.col(name)) for name in ("severity", "title", "timestamp", "description")]
    return (
        rows(facts, "overview", F.lit(1), *head)
        .unionByName(rows(summary, "summary", F.lit(1), (F.lit("executive_summary"), F.col("executive_summary"))))
        .unionByName(rows(issues, "issues", F.col("rank"), *found))
        .unionByName(
            issues.select(
                F.lit("remediation").alias("section"),
                "rank",
                F.posexplode("remediation").alias("key", "value"),
            ).withColumn("key", F.col("key").cast("string"))
        )
        .unionByName(
            issues.select(F.lit("snippets").alias("section"), "rank", F.posexplode("snippets").alias("key", "value"))
            .withColumn("key", F.col("key").cast("string"))
        )
        .unionByName(rows(anomalies, "anomalies", F.col("section"), *alerts))
    )
