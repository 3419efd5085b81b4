"""Near-duplicate documents by fast similarity sketching.

A document's set holds its distinct word shingles. Its sketch has ``COORDS``
bins filled in rounds: in round i every shingle is thrown by hash into one bin
and competes with its hash value; bins that stay empty wait for the next
round, and from round ``COORDS`` on all shingles compete for one bin per
round, so every bin is filled. Equal bins of two sketches estimate the Jaccard
similarity with the concentration of sampling without replacement.

1. Documents with equal sets are one class; its least document stands for it.
2. Bands of ``ROWS`` bins are hashed to bucket keys. Each class is compared
   with the least class of its buckets, on the full sets, and what is linked
   becomes components.
3. Only buckets that still hold several components are looked at further:
   where the sketches of different components agree in ``FLOOR`` of the bins
   or more, their documents form a cluster (members of a bucket's largest
   component meet the others only, not each other). Clusters are compared on the full
   sets, two blocks of documents at a time, and what is linked joins its
   components. Both steps return a row per document and meeting of blocks,
   not a row per pair.

A link that no bucket holds is lost with probability (1 - s^ROWS)^(COORDS /
ROWS), 1.4e-7 at s = 0.8, or if its sketches agree in less than ``FLOOR``
(five standard deviations below 0.8).

Rules: null and word-less texts have no set and link with nothing; a text
shorter than a shingle is one shingle; rows of one id are one node; rows
without an id link with nothing; an empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.cuckoo import spread
from logloom.llm.frames import batched, doc_table, ranges, stored
from logloom.llm.meetings import each_meeting, local_least, met_in_blocks, strangers_in_blocks

COORDS = 120
ROWS = 4
FLOOR = 0.62
# Members of a bucket that are compared by sketch at once, and texts of a
# cluster that are compared on their sets.
BUCKET_BLOCK = 1024
BLOCK = 128
# Bytes of text whose distinct words are numbered at once.
SLICE_BYTES = 4 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = spread(np.arange(1, 2 * COORDS + 1, dtype=np.uint64))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (ASCII letters lowered).

    Arrow splits the words and numbers the distinct ones, which alone are
    hashed here.
    """
    import xxhash

    out: list[np.ndarray] = []
    texts = pc.ascii_lower(texts.cast(pa.large_string()).fill_null(""))
    for a, b in ranges(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
        split = pc.ascii_split_whitespace(texts.slice(a, b - a))
        numbered = split.flatten().dictionary_encode()
        distinct = numbered.dictionary.cast(pa.large_binary()).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        codes, places = numbered.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
        real = np.fromiter(map(len, distinct), np.int64, len(distinct))[codes] > 0
        words = hashes[codes]
        for x, y in zip(places, places[1:]):
            out.append(_shingles(words[x:y][real[x:y]], width))
    return out


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    width = min(width, len(words))
    if not width:
        return words
    with np.errstate(over="ignore"):
        mixed = words[: len(words) - width + 1]
        for i in range(1, width):
            mixed = spread(mixed * _A + words[i : len(words) - width + 1 + i] * _B + np.uint64(i))
    return np.unique(mixed)


def sketch(items: np.ndarray) -> np.ndarray:
    """``COORDS`` 32-bit coordinates of a non-empty set.

    As many rounds are thrown at once as fill all bins with high probability;
    a bin takes its value from the earliest round that reaches it.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least, turn = np.full(COORDS, none), 0
    together = max(1, -(-8 * COORDS // len(items)))
    while turn < COORDS and (least == none).any():
        turns = np.arange(turn, min(COORDS, turn + together), dtype=np.uint64)
        hashed = spread(items[None, :] ^ _SEEDS[turn : turn + len(turns), None])
        bins = (hashed >> np.uint64(32)) * np.uint64(COORDS) >> np.uint64(32)
        np.minimum.at(least, bins.astype(np.int64).ravel(), (turns[:, None] << np.uint64(32) | hashed & np.uint64(0xFFFFFFFF)).ravel())
        turn += len(turns)
    for i in np.flatnonzero(least == none):  # these rounds throw everything into one bin
        least[i] = spread(items ^ _SEEDS[COORDS + i]).min() >> np.uint64(32) | np.uint64(COORDS + i) << np.uint64(32)
    return (spread(least) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(coords: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; the band's number is mixed in."""
    bands = coords.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = spread(key * _A + bands[:, i])
    return key.view(np.int64)


def sketch_table(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, s1, s2, sketch``; s1 and s2 identify the set."""

    def work(batch: pa.RecordBatch) -> dict:
        import xxhash

        out: dict[str, list] = {k: [] for k in ("n_shingles", "s1", "s2", "sketch")}
        for items in shingle_sets(batch["text"], width):
            pair = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), "<i8").tolist() if len(items) else [None, None]
            for k, v in zip(out, (len(items), *pair, sketch(items).tobytes() if len(items) else None)):
                out[k].append(v)
        return out | {"doc_id": batch["doc_id"]}

    return batched(doc_table(docs), work, "doc_id long, n_shingles long, s1 long, s2 long, sketch binary")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """``node, key``: each class in each of its buckets."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"node": batch["node"], "keys": [band_keys(np.frombuffer(s, np.uint32)) for s in batch["sketch"].to_pylist()]}

    return batched(reps, work, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose full sets are similar enough."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = pa.concat_arrays([batch["text_u"], batch["text_v"]]).dictionary_encode()
        sets, at = shingle_sets(texts.dictionary, width), texts.indices.to_numpy()
        u, v = [], []
        for a, b, i, j in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), at, at[batch.num_rows :]):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                u.append(a)
                v.append(b)
        return {"u": u, "v": v}

    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in ("u", "v"))
    return batched(pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v"), work, "u long, v long")


def agreeing(mixed: DataFrame, reps: DataFrame, block: int = BUCKET_BLOCK) -> DataFrame:
    """``u, v``: v is the least node that u reaches through sketches agreeing
    across components within a bucket (v = u if it is the least itself).

    ``mixed`` has ``key, node, component`` and is read more than once, so it
    should be stored; ``reps`` has the sketches. A row per node and meeting
    comes out, never a row per pair.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for _, part, mask in each_meeting(rows, "key"):
            coords, label, nodes = np.stack([np.frombuffer(s, np.uint32) for s in part["sketch"]]), part["component"].to_numpy(), part["node"].to_numpy()
            mask &= label[:, None] != label[None, :]
            same = np.zeros(mask.shape, np.int32)
            for column in coords.T:
                same += column[:, None] == column[None, :]
            mask &= same >= FLOOR * COORDS
            seen = mask.any(axis=0) | mask.any(axis=1)
            if seen.any():
                u.append(nodes[seen])
                v.append(local_least(nodes, *np.nonzero(mask))[seen])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)} if u else {"u": [], "v": []}, dtype="int64")

    return strangers_in_blocks(mixed, "key", "component", block).join(reps, "node").groupBy("meeting").applyInPandas(compare, "u long, v long").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, by products of 0/1 blocks of columns."""
    sizes = [len(s) for s in sets]
    items, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column) > 1
    column, row = np.where(often, np.cumsum(often) - 1, -1)[column], np.repeat(np.arange(len(sets)), sizes)
    column, row = column[column >= 0], row[column >= 0]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.diag(np.array(sizes, np.float32))
    off = np.zeros_like(out)
    for start in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        off += part @ part.T
    np.fill_diagonal(off, 0)
    return off + out


def verified_within(clusters: DataFrame, texts: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``u, v`` links on full sets among the texts of each cluster.

    ``clusters`` has ``cluster, node`` and should be stored; a row per node
    and meeting comes out: the least node that links reach within the meeting.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for _, part, mask in each_meeting(rows, "cluster"):
            nodes, sets = part["node"].to_numpy(), shingle_sets(pa.array(part["text"], pa.large_string()), width)
            both, size = shared_counts(sets).astype(np.int64), np.array([len(s) for s in sets])
            mask &= 100 * both >= percent * (size[:, None] + size[None, :] - both)
            least = local_least(nodes, *np.nonzero(mask))
            u.append(nodes[least < nodes])
            v.append(least[least < nodes])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)} if u else {"u": [], "v": []}, dtype="int64")

    return met_in_blocks(clusters, "cluster", block).join(texts, "node").groupBy("meeting").applyInPandas(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    table = stored(sketch_table(docs, width), "sketches")
    usable = table.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "classes")
    reps = stored(usable.join(classes.withColumnRenamed("node", "doc_id"), ["s1", "s2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "sketch"), "reps")
    buckets = stored(bucket_rows(reps), "buckets")
    least = buckets.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most").select("key", "v")
    stars = stored(buckets.join(least, "key").where("node > v").select(F.col("node").alias("u"), "v").distinct(), "stars")
    asked = stars.select(F.col("u").alias("doc_id")).unionByName(stars.select(F.col("v").alias("doc_id"))).distinct()
    # The ids asked for grow with the input: they are merged, never broadcast.
    texts = stored(doc_table(docs).join(asked.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")
    links = stored(verified(stars, texts, width, percent), "links")
    known = stored(components(links), "known")
    # buckets that hold several components yet
    named = buckets.join(stars.select(F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("node"))).distinct(), "node", "left_semi")
    named = named.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    close = stored(agreeing(stored(named.join(several, "key", "left_semi"), "several"), reps), "close")
    cluster = stored(components(close).withColumnRenamed("component", "cluster"), "clusters")
    more = verified_within(cluster, texts, width, percent)
    same_set = table.join(classes, ["s1", "s2"]).where("doc_id > node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = stored(components(links.unionByName(more).unionByName(same_set)), "components")
    joined = table.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns kept."""
    gone = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
