"""A training corpus from raw documents: filter, dedup, mix, pack.

Each stage takes (spark, docs, folder of the tables) and returns a frame that
is written and read again as the next stage's ``docs``. All but the last keep
the columns of ``documents``:

1. quality rules: documents that a rule rejects go;
2. line dedup: lines that a lesser document holds go, so texts get shorter;
3. near-dedup: of documents with similar sets of five-word shingles the least
   stays;
4. mixing: a document comes as often as the mix of sources takes it;
5. packing: pieces of token sequences.

Documents without an id pass every stage as documents of their own; an empty
input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.frames import stored
from logloom.llm.line_dedup import dedup_lines
from logloom.llm.minhash_dedup import without_near_duplicates
from logloom.llm.mixing import mixture
from logloom.llm.packing import packed
from logloom.llm.quality_rules import passing


# Rows that a Python step gets at once: some 4 MB of text, what it works on
# together. Executor and worker hold several copies of what travels.
BATCH_ROWS = 2000


def in_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_batches(spark)
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_batches(spark)
    cut = dedup_lines(docs)
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_batches(spark)
    return without_near_duplicates(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_batches(spark)
    return mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_batches(spark)
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

# No SQL: the tokenizer and the packing have none. Tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
