"""Token ids in ORC files, in document order.

ORC stores integers run-length encoded in stripes; each stripe holds a row
index (minimum and maximum every ``INDEX_ROWS`` rows) and Bloom filters on the
document id. Readers take stripes in parallel, and a look-up of some ids skips
the stripes and row groups whose metadata rules them out.

Rules: null text is empty; each document's ids end with ``end_id``; repeated
ids keep all their rows, ordered by a hash of the text and the text; null ids
come last; an empty input gives an empty store.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.llm.frames import batched, doc_table
from logloom.llm.word_tokens import WORD_BPE, encoder

STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
BLOOM_FPP = 0.01
SCHEMA = "doc_id long, tie long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = 1) -> None:
    """Encode whole texts and write ``doc_id, tie, n_tokens, ids`` as ORC.

    Texts are dealt into ranges of ids before they are encoded, so encoding
    runs once and each file is one sorted range. The hash beside the id cuts
    ranges even where one id has many rows.
    """
    table = doc_table(docs).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("text")]
    ordered = table.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    end = int(end_id).to_bytes(4, "little")

    def encode(batch: pa.RecordBatch) -> dict:
        ids = [v + end for v in encoder(tokenizer).encode(batch["text"])]
        lengths = np.fromiter((len(v) // 4 for v in ids), np.int32, len(ids))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), np.int32))
        return {"doc_id": batch["doc_id"], "tie": batch["tie"], "n_tokens": lengths, "ids": pa.ListArray.from_arrays(pa.array(offsets), values)}

    (
        batched(ordered, encode, SCHEMA, uses=(encoder,)).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.create.index", "true").option("orc.row.index.stride", str(INDEX_ROWS)).option("orc.stripe.size", str(STRIPE_BYTES)).orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the filter reaches the ORC reader."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids)).drop("tie")


def token_places(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` as the files hold them.

    A file is one range of ids, so files are ordered by their least row (their
    names aren't: part numbers grow from five digits to six). Running sums are
    taken per file, and the sums of whole files over one small row per file.
    """

    def digest(batch: pa.RecordBatch) -> dict:
        ids, offsets = batch["ids"].flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(batch["n_tokens"].to_numpy())])
        raw = memoryview(ids).cast("B") if len(ids) else b""
        return {k: batch[k] for k in ("file", "doc_id", "tie")} | {"n_tokens": batch["n_tokens"].cast(pa.int64()), "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]}

    stored = read_tokens(spark, path).select("doc_id", "tie", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))
    rows = batched(stored, digest, "file string, doc_id long, tie long, n_tokens long, ids_crc32 long")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tie")).alias("least")
    files = stored.groupBy("file").agg(F.sum("n_tokens").alias("total"), least)
    before = files.select("file", (F.sum("total").over(Window.orderBy("least")) - F.col("total")).alias("before"))
    here = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_last(), "tie", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(here)).join(before, "file")
    return placed.select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
