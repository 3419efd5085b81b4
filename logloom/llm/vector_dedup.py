"""Near-duplicate vectors by cross-polytope hashing with verified links.

Each of some tables turns a vector by ``HASHES`` fast rotations (signs
and Hadamard transforms, three times) and hashes each to the axis it is
nearest to, with its sign; the axes together name a bucket. A vector lives in
its home bucket and also visits ``PROBES`` buckets, in which the axis with the
least lead is replaced by the next nearest. Pairs that meet where one of them
is at home are compared by cosine in double precision.

Equal vectors are one class with a number of copies. Only buckets with two
classes or more are looked at. A bucket is cut into blocks, two blocks meet at
a time, and a meeting returns a row per vector: the links it counts and the
least vector it reaches. A link that many meetings see is counted in the first
table and bucket where it can be seen, which both vectors' codes tell, so no
pair is ever written.

A link is lost if its vectors meet in no table. ``table_count`` takes as many
tables as keep that chance within ``MISS`` (1e-5) for a pair right at the
threshold, by the width that the vectors are padded to (at 0.95: 28 for up to
64 components, 35 up to 128, 41 up to 256); pairs above it are lost less often.
The chance is over the signs drawn: it holds for vectors that were not made
against the fixed seed. No exact search stands behind it.

Rules: null, zero and non-finite vectors, and those of a null id, link with
nothing; vectors of different length never meet and don't link; rows of one id are one
node, whose vector is the one with the least hash; an empty input gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.cuckoo import spread
from logloom.llm.frames import batched, stored
from logloom.llm.meetings import each_meeting, local_least, met_in_blocks

# Chance at most that no table shows a link at the threshold.
MISS = 1e-5
HASHES = 4
PROBES = 3
# Three rounds of signs and Hadamard turn fewer axes than this too few ways.
LEAST_WIDTH = 64
# Pairs on which the misses of one table are measured, as far as so many components go.
TRIALS = 16384
TRIAL_SIZE = 1 << 23
BLOCK = 128
SLICE = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, in place."""
    width, step = x.shape[1], 1
    while step < width:
        pairs = x.reshape(len(x), -1, 2, step)
        a, b = pairs[:, :, 0, :] + pairs[:, :, 1, :], pairs[:, :, 0, :] - pairs[:, :, 1, :]
        pairs[:, :, 0, :], pairs[:, :, 1, :] = a, b
        step *= 2
    return x


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def padded_width(dim: int) -> int:
    return max(LEAST_WIDTH, 1 << (dim - 1).bit_length())


def bucket_codes(vectors: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 0) -> np.ndarray:
    """``rows x tables x (1 + probes)`` bucket keys, home first."""
    n, dim = vectors.shape
    width = padded_width(dim)
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, width))
    padded = np.zeros((n, width))
    padded[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    with np.errstate(over="ignore"):
        for t in range(tables):
            near, lead = np.empty((2, n, hashes), np.uint64), np.empty((n, hashes))
            for h in range(hashes):
                turned = rotated(padded.copy(), signs[t, h])
                size = np.abs(turned)
                for i in range(2):
                    axis = size.argmax(axis=1)
                    near[i, :, h] = 2 * axis + (turned[rows, axis] < 0)
                    lead[:, h] = size[rows, axis] if i == 0 else lead[:, h] - size[rows, axis]
                    size[rows, axis] = -1
            order = np.argsort(lead, axis=1, kind="stable")
            for p in range(1 + probes):
                axes = near[0].copy()
                if p:
                    swap = order[:, (p - 1) % hashes]
                    axes[rows, swap] = near[1][rows, swap]
                key = np.full(n, (t << 32) + dim, np.uint64)  # the length, not the padded width: only vectors of one length meet
                for h in range(hashes):
                    key = spread(key * np.uint64(0x9E3779B97F4A7C15) + axes[:, h])
                out[:, t, p] = key.view(np.int64)
    return out


@lru_cache(64)
def table_count(width: int, threshold: float, hashes: int = HASHES, probes: int = PROBES, miss: float = MISS) -> int:
    """Tables that leave a pair at the threshold apart with chance ``miss`` at most.

    A table's own misses are counted on random pairs at the threshold and taken
    four standard deviations higher; signs are drawn per table, so the misses
    of several tables multiply.
    """
    cosine, at_once = min(threshold, 1.0), max(64, min(4096, (1 << 18) // width))
    turns = -(-max(1024, min(TRIALS, TRIAL_SIZE // width)) // at_once)
    missed = 0
    for turn in range(turns):
        a, b = np.random.default_rng(turn).normal(size=(2, at_once, width))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        one, two = (bucket_codes(x, 1, hashes, probes, seed=turn + 1)[:, 0] for x in (a, cosine * a + np.sqrt(1 - cosine**2) * b))
        missed += int((~((one[:, :1] == two) | (two[:, :1] == one)).any(axis=1)).sum())
    trials = turns * at_once
    rate = missed / trials
    rate += 4 * np.sqrt(rate * (1 - rate) / trials) + 4 / trials
    if rate >= 1:
        raise ValueError(f"no number of tables finds vectors at cosine {threshold} with {hashes} hashes; take fewer")
    return max(1, int(np.ceil(np.log(miss) / np.log(rate))))


def vector_table(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, s1, s2, vector``: doubles as bytes, null where unusable."""

    def work(batch: pa.RecordBatch) -> dict:
        import xxhash

        out: dict[str, list] = {k: [] for k in ("s1", "s2", "vector")}
        for vec_id, values in zip(batch["vec_id"].to_pylist(), batch["values"].to_pylist()):
            row: tuple = (None, None, None)
            if vec_id is not None and values and None not in values:
                v = np.asarray(values, float) + 0.0  # -0.0 and 0.0 are one
                if np.isfinite(v).all() and v.any():
                    raw = v.tobytes()
                    row = (*np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8").tolist(), raw)
            for k, value in zip(out, row):
                out[k].append(value)
        return out | {"vec_id": batch["vec_id"]}

    chosen = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("values"))
    return batched(chosen, work, "vec_id long, s1 long, s2 long, vector binary")


def meeting_links(bucket: int, rows: pd.DataFrame, mask: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Per row the links that this meeting has to count, weighed by copies,
    and the least node that the row reaches in it."""
    nodes, copies, home = (rows[c].to_numpy() for c in ("node", "copies", "home"))
    vectors = np.frombuffer(b"".join(rows["vector"]), float).reshape(len(rows), -1)
    norms = np.linalg.norm(vectors, axis=1)
    close = mask & (home[:, None] | home[None, :]) & (vectors @ vectors.T / (norms[:, None] * norms[None, :]) >= threshold)
    a, b = np.nonzero(close)
    links = np.zeros(len(rows), np.int64)
    if len(a):
        codes = np.frombuffer(b"".join(rows["codes"]), np.int64).reshape(len(rows), -1, int(rows["width"].iloc[0]))
        counted = np.zeros(len(a), bool)
        for i in range(0, len(a), SLICE):
            one, two = codes[a[i : i + SLICE]], codes[b[i : i + SLICE]]
            at_a = (one[:, :, :1] == two).any(axis=2)  # b comes to a's home
            at_b = (two[:, :, :1] == one).any(axis=2)
            pick, first = np.arange(len(one)), (at_a | at_b).argmax(axis=1)
            counted[i : i + SLICE] = np.where(at_a[pick, first], one[pick, first, 0], two[pick, first, 0]) == bucket
        np.add.at(links, a[counted], copies[b[counted]])
        np.add.at(links, b[counted], copies[a[counted]])
    return nodes, links, local_least(nodes, a, b)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tables: int | None = None, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``tables`` follows from ``miss``, the threshold and the vectors' length
    unless it is given.
    """
    table = stored(vector_table(vectors, id_col, vector_col), "vectors")
    distinct = table.where("vector IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("s1", "s2")).alias("s")).select("vec_id", "s.s1", "s.s2")
    classes = stored(distinct.groupBy("s1", "s2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "classes")
    same = table.join(classes, ["s1", "s2"]).where("vec_id = node").dropDuplicates(["node"]).select("node", "copies", "vector")

    def code(batch: pa.RecordBatch) -> dict:
        raw = batch["vector"].to_pylist()
        codes: list = [None] * len(raw)
        for size in {len(v) for v in raw}:  # vectors of one length at a time
            at = [i for i, v in enumerate(raw) if len(v) == size]
            many = tables or table_count(padded_width(size // 8), threshold, hashes, probes, miss)
            for i in range(0, len(at), SLICE):
                part = at[i : i + SLICE]
                for j, c in zip(part, bucket_codes(np.stack([np.frombuffer(raw[j], float) for j in part]), many, hashes, probes)):
                    codes[j] = c
        return {"node": batch["node"], "copies": batch["copies"], "vector": batch["vector"], "codes": [c.tobytes() for c in codes], "keys": [c.ravel() for c in codes]}

    coded = stored(batched(same, code, "node long, copies long, vector binary, codes binary, keys array<long>"), "codes")
    member = coded.select("node", F.posexplode("keys").alias("place", "key")).select("key", "node", (F.col("place") % (1 + probes) == 0).alias("home"))
    member = member.groupBy("key", "node").agg(F.max("home").alias("home"))
    shared = member.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("used")).where("n > 1 AND used").select("key")
    member = stored(member.join(shared, "key"), "members")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [meeting_links(bucket, part, mask, threshold) for bucket, part, mask in each_meeting(rows, "key")]
        out = pd.DataFrame(dict(zip(("node", "n_links", "least"), map(np.concatenate, zip(*parts)))))
        return out[(out["n_links"] > 0) | (out["least"] < out["node"])]

    met = met_in_blocks(member, "key", block).join(coded.drop("keys"), "node").withColumn("width", F.lit(1 + probes))
    found = stored(met.groupBy("meeting").applyInPandas(compare, "node long, n_links long, least long"), "found")
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    reach = components(found.where("least < node").select(F.col("node").alias("u"), F.col("least").alias("v")))
    per_class = classes.join(links, "node", "left").join(reach, "node", "left")
    per_class = per_class.select("s1", "s2", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    rows = table.drop("vector").join(per_class, ["s1", "s2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (component == F.col("vec_id"))).alias("kept"))
