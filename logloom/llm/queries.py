"""Queries of this package over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import oracles

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_token_store")
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.frames import new_dir
    from logloom.llm.token_store import token_places, write_tokens

    path = new_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_places(spark, path)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.frames import small_batches, stored
    from logloom.llm.token_counts import budgeted, prefix_counts

    small_batches(spark)
    return budgeted(stored(prefix_counts(table(spark, sf_dir, "documents"), budget=4096), "prefixes"), 4096)


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.packing import packed

    return packed(table(spark, sf_dir, "documents")).drop("row")


@query("op1_line_dedup", oracles.LINE_DEDUP)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.line_dedup import dedup_lines

    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op2_quality_rules", oracles.QUALITY_RULES)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.quality_rules import verdicts

    return verdicts(table(spark, sf_dir, "documents"))


@query("op6_mixing", oracles.MIXING)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


@query("op7_quality_model")
def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.quality_model import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_minhash_dedup")
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op8_vector_dedup")
def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.vector_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.95)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.suffix_dedup import without_repeats

    cut = without_repeats(table(spark, sf_dir, "documents"), 400)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_merkle_manifest", oracles.MERKLE)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.merkle import manifest, verified

    return verified(manifest(table(spark, sf_dir, "documents")))


@query("op13_decontamination", oracles.DECONTAMINATION)
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.alignment import cross_aligned

    return cross_aligned(table(spark, sf_dir, "documents"))
