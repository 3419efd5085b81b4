"""Masks, signatures and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import render as r
from checks.registry import query
from logloom.functions import templates as tf
from logloom.operators import anomalies as an
from logloom.operators import templates as tm
from logloom.sources.workspace import stored

LOGS = r.logs_sql()
RARE = r.logs_sql(message=r.RARE_MESSAGE)


def _masked(text: str) -> str:
    for pattern, name in [
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
        (r"0x[0-9a-fA-F]+", "<HEX>"),
        (r"\b[0-9a-fA-F]{16,64}\b", "<HASH>"),
        (r"\b\d+\b", "<NUM>"),
        (r"https?://\S+", "<URL>"),
        (r"(/[\w.-]+)+/?", "<PATH>"),
    ]:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


SIGNED = f"""{LOGS}, signed AS (SELECT *, {_masked('message')} AS signature FROM logs),
 split AS (SELECT *, string_split(signature, ' ') AS tokens, len(string_split(signature, ' ')) AS n_tokens FROM signed)"""



@query(
    "mask_message",
    f"""{LOGS} SELECT 'events' AS origin, line_number AS id, {_masked('message')} AS masked FROM logs
 UNION ALL SELECT 'pages', page_id, {_masked('url')} FROM pages""",
)
def _(spark, sf):
    logs = r.log_table(spark, sf).select(F.lit("events").alias("origin"), F.col("line_number").alias("id"), "message")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.lit("pages").alias("origin"), "page_id", "url")
    return logs.union(pages).select("origin", "id", tf.mask(F.col("message")).alias("masked"))


@query("mask_documents")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", tf.mask(F.col("text")).alias("masked"))


_SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(
    "tokenize",
    f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', '|', 'g') AS tokens FROM documents)
 SELECT doc_id, tokens, CAST(CASE WHEN tokens = '' THEN 0 ELSE len(regexp_extract_all(tokens, '\\|')) + 1 END
  - len(regexp_extract_all((SELECT text FROM documents d WHERE d.doc_id = t.doc_id), '\\|')) AS BIGINT) AS n_tokens FROM t""",
)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokens = tf.tokenize(F.col("text"))
    return docs.select("doc_id", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).cast("bigint").alias("n_tokens"))


@query(
    "signature_counts",
    f"""{SIGNED} SELECT signature, count(*) AS size, count(*) FILTER (level = 'ERROR') AS error_count,
 min(line_number) AS first_line, arg_min(epoch, line_number) AS first_seen, arg_max(epoch, line_number) AS last_seen
 FROM signed GROUP BY signature""",
)
def _(spark, sf):
    counts = tm.signature_counts(r.log_table(spark, sf))
    epoch = lambda c: (F.unix_micros(c) / F.lit(1e6)).alias(c)
    return counts.select(
        "signature", "size", "error_count", F.col("first_ord.line_number").alias("first_line"), epoch("first_seen"), epoch("last_seen")
    )


@query(
    "template_similarity",
    f"""{SIGNED} SELECT a.line_number, CASE WHEN a.n_tokens <> b.n_tokens THEN 0e0
 ELSE len(list_filter(list_zip(a.tokens, b.tokens), lambda p: p[1] = p[2])) / a.n_tokens END AS similarity
 FROM split a JOIN split b ON b.line_number = a.line_number + 1""",
)
def _(spark, sf):
    rows = tm.with_signature(r.log_table(spark, sf)).select("line_number", tf.tokens_of(F.col("signature")).alias("tokens"))
    before = rows.select((F.col("line_number") - 1).alias("line_number"), F.col("tokens").alias("following"))
    return rows.join(before, "line_number").select("line_number", tf.similarity(F.col("tokens"), F.col("following")).alias("similarity"))


def _by_length(spark, sf, masked: bool = True) -> DataFrame:
    """Rows with their tokens, grouped by word count as if each were a template."""
    logs = r.log_table(spark, sf).select("source", "line_number", "message")
    texts = tm.with_signature(logs) if masked else logs.withColumn("signature", F.col("message"))
    rows = texts.select("source", "line_number", tf.tokenize(F.col("signature")).alias("tokens"))
    return rows.withColumn("n_tokens", F.size("tokens").cast("bigint"))


_TEXT = """words AS (SELECT DISTINCT n_tokens, i, tokens[i] AS w FROM (SELECT n_tokens, tokens, unnest(range(1, n_tokens + 1)) AS i FROM split)),
 pos AS (SELECT n_tokens, i, CASE WHEN count(*) > 1 THEN '<*>' ELSE any_value(w) END AS w FROM words GROUP BY n_tokens, i),
 tpl AS (SELECT n_tokens, string_agg(w, ' ' ORDER BY i) AS template, list(w ORDER BY i) AS t FROM pos GROUP BY n_tokens)"""


@query("template_text", f"{SIGNED}, {_TEXT} SELECT n_tokens, template FROM tpl")
def _(spark, sf):
    return tm.template_text(_by_length(spark, sf), "n_tokens")


@query(
    "template_params",
    f"""{LOGS}, split AS (SELECT line_number, string_split(message, ' ') AS tokens, len(string_split(message, ' ')) AS n_tokens FROM logs), {_TEXT},
 ranked AS (SELECT *, row_number() OVER (PARTITION BY n_tokens ORDER BY line_number) AS rank FROM split JOIN tpl USING (n_tokens)
  WHERE template LIKE '%<*>%')
 SELECT n_tokens, rank, array_to_string([tokens[i] FOR i IN range(1, n_tokens + 1) IF t[i] = '<*>'], '|') AS params FROM ranked WHERE rank <= 5""",
)
def _(spark, sf):
    rows = _by_length(spark, sf, masked=False)
    params = tm.template_params(rows, tm.template_text(rows, "n_tokens"), "n_tokens")
    return params.select("n_tokens", F.col("rank").cast("bigint").alias("rank"), F.array_join("params", "|").alias("params"))


@query(
    "match_templates",
    f"""{SIGNED}, {_TEXT} SELECT signature, template FROM (SELECT DISTINCT signature, tokens, n_tokens FROM split) JOIN tpl USING (n_tokens)
 WHERE len(list_filter(list_zip(tokens, t), lambda p: p[1] = p[2] OR p[2] = '<*>')) = n_tokens""",
)
def _(spark, sf):
    rows = tm.with_signature(r.log_table(spark, sf)).select("signature").distinct()
    rows = rows.select("signature", tf.tokens_of(F.col("signature")).alias("tokens"))
    rows = rows.withColumn("n_tokens", F.size("tokens").cast("bigint"))
    texts = tm.template_text(_by_length(spark, sf), "n_tokens")
    templates = texts.withColumn("tokens", F.split("template", " "))
    return tm.match_templates(rows, templates).select("signature", "template")


# The greedy rule row by row: ``run`` holds all templates after each row.
def loop(logs: str) -> str:
    return f"""{logs.replace('WITH logs', 'WITH RECURSIVE logs', 1)},
 split AS MATERIALIZED (SELECT line_number, string_split({_masked('message')}, ' ') AS w FROM logs),
 run(k, id, tpl) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[][])
  UNION ALL SELECT k + 1, CASE WHEN share >= 0.5 THEN best ELSE len(tpl) + 1 END,
   CASE WHEN share >= 0.5 THEN tpl[:best - 1]
     || [[CASE WHEN x[1] = x[2] THEN x[1] ELSE '<*>' END FOR x IN list_zip(tpl[best], w)]] || tpl[best + 1:]
    ELSE tpl || [w] END
  FROM (SELECT k, tpl, w, list_max(shares) AS share, list_position(shares, list_max(shares)) AS best
   FROM (SELECT k, tpl, w, [CASE WHEN len(t) = len(w)
      THEN len([1 FOR x IN list_zip(t, w) IF x[1] = x[2] OR x[1] = '<*>']) / len(w) ELSE -1e0 END FOR t IN tpl] AS shares
    FROM run JOIN split ON split.line_number = run.k + 1))),
 final AS (SELECT tpl FROM run WHERE k = (SELECT max(k) FROM run))"""


LOOP = loop(r.logs_sql(message=r.NAMED_MESSAGE))
FOUND = f"""{LOOP} SELECT unnest(range(1, len(tpl) + 1)) AS template_id,
 unnest([array_to_string(t, ' ') FOR t IN tpl]) AS template FROM final"""


@query("mine_templates", FOUND)
def _(spark, sf):
    return tm.mine_templates(r.log_table(spark, sf, message=r.NAMED_MESSAGE)).latest().select("template_id", "template")


@query("mine_document_templates")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    logs = docs.select(F.col("source").alias("source"), F.col("doc_id").alias("line_number"), F.col("text").alias("message"))
    return tm.mine_templates(logs).latest().select("template_id", "n_tokens", "template")


@query("assign_templates", f"{LOOP} SELECT k AS line_number, id AS template_id FROM run WHERE k > 0")
def _(spark, sf):
    logs = r.log_table(spark, sf, message=r.NAMED_MESSAGE)
    return tm.assign_templates(logs, tm.mine_templates(logs), same_logs=True).select("line_number", "template_id")


@query(
    "sample_params",
    f"""{LOOP}, late AS (SELECT id, k, w, tpl[id] AS t FROM run JOIN split ON split.line_number = run.k WHERE list_contains(tpl[id], '<*>')),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rank FROM late)
 SELECT id AS template_id, rank, array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF t[i] = '<*>'], '|') AS params FROM ranked WHERE rank <= 5""",
)
def _(spark, sf):
    logs = r.log_table(spark, sf, message=r.NAMED_MESSAGE)
    mined = tm.mine_templates(logs)
    shown = tm.sample_params(tm.assign_templates(logs, mined, same_logs=True), mined)
    return shown.select("template_id", F.col("rank").cast("bigint").alias("rank"), F.array_join("params", "|").alias("params"))


def _by_signature(spark, sf, **options) -> tuple[DataFrame, DataFrame]:
    """Template summary with each signature as a template of its own."""
    logs = r.log_table(spark, sf, **options)
    rows = stored(tm.with_signature(logs).drop("message", "raw"), "signed")
    templates = rows.select("signature", F.col("signature").alias("template")).distinct()
    return rows, tm.template_summary(rows, templates, "signature", logs=logs)


_ISO = """strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END || '+00:00'"""
_SUMMARY = f"""SELECT signature, count(*) AS size, count(*) FILTER (level = 'ERROR') AS error_count,
 {_ISO.format('arg_min(ts0, line_number)')} AS first_seen, {_ISO.format('arg_max(ts0, line_number)')} AS last_seen,
 string_agg(message, '|' ORDER BY line_number) FILTER (rank <= 5) AS samples
 FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY line_number) AS rank FROM signed) GROUP BY signature"""


@query("template_summary", f"{SIGNED} {_SUMMARY}")
def _(spark, sf):
    _, summary = _by_signature(spark, sf)
    return summary.withColumn("samples", F.array_join("samples", "|")).drop("template")


@query(
    "rare_templates",
    f"""{RARE}, signed AS (SELECT *, {_masked('message')} AS signature FROM logs), summary AS ({_SUMMARY})
 SELECT signature, size, error_count, samples FROM summary WHERE error_count > 0 AND size <= 2 AND (SELECT count(*) FROM logs) > 50""",
)
def _(spark, sf):
    rows, summary = _by_signature(spark, sf, message=r.RARE_MESSAGE)
    rare = an.rare_templates(summary, rows).withColumn("samples", F.array_join("samples", "|"))
    return rare.select("signature", "size", "error_count", "samples")
