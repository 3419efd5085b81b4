"""Line dedup that can be undone: cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII white space and with A-Z lowered;
keys of at least ``LEAST_CHARS`` code points count. The index is a list of
versions, each a folder with what it changed:

* ``refs``: which added document holds which key (the references),
* ``gone``: which documents left; references of older versions to them are void,
* ``counts``: per key touched the exact number of documents and the least of
  them; the newest row of a key holds, 0 documents mean none,
* ``filters``: per shard of keys touched a cuckoo filter of the *repeated* keys,
  those with at least two documents; the newest of a shard holds.

Inserting and deleting documents write one more version in proportion to what
changed. Old versions stay readable. They look up the keys touched in the
older versions by a join on the keys, so nothing old is shuffled while the
change is small. A filter that would be too full is built anew at twice the
size from its shard's counts. ``compacted`` writes all as one version with as
many shards as the keys now need.

To apply the index, references go to their key's shard (split further by
document where a shard has many references, so that a line in a third of all
documents is spread out), the filter drops those that certainly aren't
repeated, and the few left are looked up in the exact counts.

Rules: null text is one empty line; documents without an id count together as
one document that comes last; rows of one id are one document; an empty input
gives no rows; other columns pass through, except that ``counts=True`` replaces
columns ``n_lines`` and ``n_dropped``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.llm.cuckoo import LOAD, CuckooFilter
from logloom.llm.frames import as_bytes, batched, doc_table, new_dir, only, stored
from logloom.sources.workspace import broadcast_if_small, settle

LEAST_CHARS = 10
# Keys of a shard, and references that one task compares with a filter.
SHARD_KEYS = 16_000
TASK_REFS = 16_000
NO_ID = (1 << 63) - 1
WHITE = b" \t\n\v\f\r"
REF_SCHEMA = "doc long, k1 long, k2 long"
COUNT_SCHEMA = "k1 long, k2 long, n_docs long, owner long"
FILTER_SCHEMA = "shard int, table binary, stash array<long>, held long"


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(WHITE).lower()
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode("utf-8", "replace")) < LEAST_CHARS:
        return None
    return key


def digests(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two longs."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def keys_of(rows: DataFrame) -> DataFrame:
    """``doc, k1, k2``: each key of each row of ``doc, text``."""

    def work(batch: pa.RecordBatch) -> dict:
        keys, owner = [], []
        for doc, text in zip(batch["doc"].to_pylist(), as_bytes(batch["text"])):
            found = dict.fromkeys(map(line_key, text.split(b"\n")))
            found.pop(None, None)
            keys += found
            owner += [doc] * len(found)
        pairs = digests(keys)
        return {"doc": owner, "k1": pairs[:, 0], "k2": pairs[:, 1]}

    return batched(rows, work, REF_SCHEMA)


def line_refs(docs: DataFrame) -> DataFrame:
    """``doc, k1, k2``: each key of each document once."""
    return keys_of(doc_table(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")).distinct()


def counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc").alias("owner"))


def shard_of(shards: int) -> Column:
    """The filters hash ``k2``; the shard comes from ``k1``."""
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def packed(made: CuckooFilter, shard: int, held: int) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "table": [made.to_bytes()], "stash": [made.stash.tolist()], "held": [held]})


def filters_of(keys: DataFrame) -> DataFrame:
    """A filter of twice the size for each shard of ``shard, k2``."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter(2 * len(rows))
        made.insert(rows["k2"].to_numpy())
        return packed(made, key[0], len(rows))

    return keys.select("shard", "k2").groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


def turned(filters: DataFrame, turns: DataFrame) -> DataFrame:
    """Filters after keys became repeated (``plus``) or ceased to be."""

    def turn(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        plus, minus = (rows["k2"][rows["plus"].astype(bool) == up].to_numpy(np.int64) for up in (True, False))
        made = CuckooFilter(table=old["table"][0], stash=old["stash"][0])
        made.delete(minus)
        made.insert(plus)
        return packed(made, key[0], int(old["held"][0]) + len(plus) - len(minus))

    return filters.groupBy("shard").cogroup(turns.groupBy("shard")).applyInPandas(turn, FILTER_SCHEMA)


@dataclass(frozen=True)
class LineIndex:
    """One state of the index: the folders of its versions, oldest first."""

    spark: SparkSession
    paths: tuple[str, ...]
    shards: int

    def _read(self, name: str, schema: str) -> DataFrame:
        """Rows of all versions with the version's number ``v``."""
        read = self.spark.read.schema(schema)
        return reduce(DataFrame.unionByName, [read.parquet(f"{p}/{name}").withColumn("v", F.lit(v)) for v, p in enumerate(self.paths)])

    @property
    def refs(self) -> DataFrame:
        rows = self._read("refs", REF_SCHEMA)
        if len(self.paths) == 1:
            return rows.drop("v")
        gone = self._read("gone", "doc long").groupBy("doc").agg(F.max("v").alias("left_at"))
        return rows.join(broadcast_if_small(settle(gone)), "doc", "left").where("left_at IS NULL OR left_at <= v").select("doc", "k1", "k2")

    def counts_of(self, keys: DataFrame | None = None) -> DataFrame:
        """The newest counts, of all keys or of those listed."""
        rows = self._read("counts", COUNT_SCHEMA)
        if keys is not None:
            rows = rows.join(broadcast_if_small(keys), ["k1", "k2"], "left_semi")
        if len(self.paths) > 1:
            rows = rows.groupBy("k1", "k2").agg(F.max_by(F.struct("n_docs", "owner"), "v").alias("c")).select("k1", "k2", "c.*")
        return rows.where("n_docs > 0").select("k1", "k2", "n_docs", "owner")

    @property
    def counts(self) -> DataFrame:
        return self.counts_of()

    @property
    def filters(self) -> DataFrame:
        rows = self._read("filters", FILTER_SCHEMA)
        if len(self.paths) == 1:
            return rows.drop("v")
        return rows.groupBy("shard").agg(F.max_by(F.struct("table", "stash", "held"), "v").alias("f")).select("shard", "f.*")

    def repeated(self) -> DataFrame:
        """``shard, k1, k2`` of repeated keys."""
        return self.counts.where("n_docs > 1").select(shard_of(self.shards).alias("shard"), "k1", "k2")

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, shard_keys: int = SHARD_KEYS) -> LineIndex:
        return cls._of(line_refs(docs), path, shard_keys)

    @classmethod
    def _of(cls, refs: DataFrame, path: str | None, shard_keys: int) -> LineIndex:
        spark, path = refs.sparkSession, path or new_dir(refs.sparkSession, "lines")
        refs.write.parquet(f"{path}/refs")
        spark.createDataFrame([], "doc long").write.parquet(f"{path}/gone")
        counted(spark.read.schema(REF_SCHEMA).parquet(f"{path}/refs")).write.parquet(f"{path}/counts")
        made = cls(spark, (path,), max(1, -(-cls(spark, (path,), 1).counts.count() // shard_keys)))
        filters_of(made.repeated()).write.parquet(f"{path}/filters")
        return made

    def compacted(self, path: str | None = None, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """The same index as one version; for after many changes."""
        return self._of(self.refs, path, shard_keys)

    def insert(self, docs: DataFrame, path: str | None = None) -> LineIndex:
        """Documents whose references are there already change nothing."""
        path = path or new_dir(self.spark, "lines")
        fresh = stored(line_refs(docs), "fresh")
        held = self.refs.join(broadcast_if_small(settle(fresh.select("doc").distinct())), "doc", "left_semi")
        fresh.join(held, ["doc", "k1", "k2"], "left_anti").write.parquet(f"{path}/refs")
        self.spark.createDataFrame([], "doc long").write.parquet(f"{path}/gone")
        plus = settle(counted(self.spark.read.schema(REF_SCHEMA).parquet(f"{path}/refs")))
        was = self.counts_of(plus.select("k1", "k2")).select("k1", "k2", F.col("n_docs").alias("was"), F.col("owner").alias("first"))
        both = plus.join(was, ["k1", "k2"], "left").withColumn("was", F.coalesce("was", F.lit(0)))
        return self._follow(path, both.select("k1", "k2", "was", (F.col("n_docs") + F.col("was")).alias("n_docs"), F.least("owner", "first").alias("owner")))

    def delete(self, doc_ids: DataFrame, path: str | None = None) -> LineIndex:
        """Take out the documents whose ``doc_id`` is listed."""
        path = path or new_dir(self.spark, "lines")
        gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
        gone.write.parquet(f"{path}/gone")
        gone = self.spark.read.schema("doc long").parquet(f"{path}/gone")
        self.spark.createDataFrame([], REF_SCHEMA).write.parquet(f"{path}/refs")
        refs = self.refs
        minus = refs.join(broadcast_if_small(gone), "doc", "left_semi")
        minus = settle(minus.groupBy("k1", "k2").agg(F.count("*").alias("less")))
        both = settle(self.counts_of(minus.select("k1", "k2")).join(minus, ["k1", "k2"]))
        # The least document of some keys left: the next one is among their references.
        lost = both.where("n_docs > less").join(broadcast_if_small(gone.withColumnRenamed("doc", "owner")), "owner", "left_semi").select("k1", "k2")
        left = refs.join(broadcast_if_small(gone), "doc", "left_anti")
        heirs = left.join(broadcast_if_small(settle(lost)), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("doc").alias("heir"))
        both = both.join(heirs, ["k1", "k2"], "left")
        return self._follow(path, both.select("k1", "k2", F.col("n_docs").alias("was"), (F.col("n_docs") - F.col("less")).alias("n_docs"), F.coalesce("heir", "owner").alias("owner")))

    def _follow(self, path: str, touched: DataFrame) -> LineIndex:
        """Write counts and filters of a version from its touched keys."""
        touched = stored(touched, "touched")
        touched.select("k1", "k2", "n_docs", "owner").write.parquet(f"{path}/counts")
        made = LineIndex(self.spark, (*self.paths, path), self.shards)
        turns = touched.where("(was > 1) <> (n_docs > 1)").select(shard_of(self.shards).alias("shard"), "k1", "k2", (F.col("n_docs") > 1).alias("plus"))
        more = F.sum(F.when(F.col("plus"), 1).otherwise(-1))
        filters = self.filters
        room = F.octet_length("table") / 2 * LOAD
        sizes = turns.groupBy("shard").agg(more.alias("more")).join(filters.select("shard", "held", room.alias("room")), "shard", "left")
        sizes = settle(sizes.select("shard", (F.col("room").isNull() | (F.col("held") + F.col("more") > F.col("room"))).alias("full")))
        few = broadcast_if_small(sizes)
        turns, same = turns.join(few, "shard").where("not full"), filters.join(few, "shard").where("not full").drop("full")
        full = made._shards_counts(sizes.where("full").select("shard"))
        turned(same, turns.select("shard", "k2", "plus")).unionByName(filters_of(full)).write.parquet(f"{path}/filters")
        return made

    def _shards_counts(self, shards: DataFrame) -> DataFrame:
        """``shard, k2`` of the repeated keys of some shards."""
        rows = self._read("counts", COUNT_SCHEMA).withColumn("shard", shard_of(self.shards)).join(broadcast_if_small(settle(shards)), "shard", "left_semi")
        newest = rows.groupBy("shard", "k1", "k2").agg(F.max_by("n_docs", "v").alias("n_docs"))
        return newest.where("n_docs > 1").select("shard", "k2")

    def drops(self, refs: DataFrame | None = None) -> DataFrame:
        """``doc, k1, k2`` of lines that another, lesser document holds."""
        refs = (self.refs if refs is None else refs).withColumn("shard", shard_of(self.shards))
        sizes = refs.groupBy("shard").agg(F.ceil(F.count("*") / TASK_REFS).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
        dealt = refs.join(sizes, "shard").select("doc", "k1", "k2", "shard", part.alias("part"))
        spread = self.filters.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "table", "stash")

        def probe(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            rows = rows[["doc", "k1", "k2"]]
            if held.empty:
                return rows.iloc[:0]
            return rows[CuckooFilter(table=held["table"][0], stash=held["stash"][0]).contains(rows["k2"].to_numpy())]

        maybe = dealt.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInPandas(probe, "doc long, k1 long, k2 long")
        exact = self.counts.where("n_docs > 1").select("k1", "k2", "owner")
        return maybe.join(exact, ["k1", "k2"]).where("doc <> owner").select("doc", "k1", "k2")


def without_lines(docs: DataFrame, drops: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with the text cut; ``counts`` adds ``n_lines`` and ``n_dropped``."""
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    inner = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"), F.struct(*(docs[c] for c in names)).alias("row"))
    # Rows without an id are one document, of any size: each looks up its own lines only.
    inner = inner.withColumn("tie", F.when(F.col("doc") == NO_ID, F.xxhash64("row.text")).otherwise(0))
    loose = keys_of(doc_table(docs).where("doc_id IS NULL").select(F.xxhash64("text").alias("doc"), "text")).distinct().withColumnRenamed("doc", "tie")
    loose = loose.join(drops.where(F.col("doc") == NO_ID), ["k1", "k2"])
    own = drops.where(F.col("doc") != NO_ID).withColumn("tie", F.lit(0).cast("long")).unionByName(loose)
    per_doc = own.groupBy("doc", "tie").agg(F.collect_list(F.struct("k1", "k2")).alias("gone"))
    joined = inner.join(per_doc, ["doc", "tie"], "left").select("row.*", F.col("gone").alias("__gone"))
    types = StructType(list(docs.schema.fields))
    if counts:
        types = types.add("n_lines", "long").add("n_dropped", "long")
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            texts, n_lines, n_dropped = batch.column(at).to_pylist(), [], []
            for i, (text, gone) in enumerate(zip(texts, batch.column(len(names)).to_pylist())):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if gone:
                    gone = {(g["k1"], g["k2"]) for g in gone}
                    keys = [line_key(line.encode()) for line in lines]
                    known = dict.fromkeys(k for k in keys if k is not None)
                    bad = {k for k, pair in zip(known, map(tuple, digests(list(known)).tolist())) if pair in gone}
                    lines = [line for line, k in zip(lines, keys) if k not in bad]
                    texts[i] = "\n".join(lines)
                n_dropped.append(n_lines[-1] - len(lines))
            arrays = [pa.array(texts, batch.column(j).type) if j == at else batch.column(j) for j in range(len(names))]
            labels = list(names)
            if counts:
                arrays, labels = arrays + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], labels + ["n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays(arrays, names=labels)

    return joined.mapInArrow(cut, types)


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """Drop repeated lines everywhere but in the least document that has them."""
    return without_lines(docs, LineIndex.build(docs).drops(), counts)
