"""Removing repeated substrings by suffix arrays over shards.

A byte goes if it lies in a string of ``length`` bytes that also starts
anywhere else, in another document or in its own. Matches never cross
documents and are judged on the input.

To bring equal strings together without comparing documents, each window of
``length`` bytes is named by the least hash among the grams inside it. Windows
that share the name and follow each other form a segment; equal windows have
equal names wherever they stand.

1. Names that occur once are done: nothing of them repeats. (A segment that
   holds its name's gram twice counts as repeated.)
2. Equal segments are one content; all windows of a content that occurs twice
   repeat.
3. Names with several contents go to shards. A shard's contents are one byte
   array, sorted by induced sorting; permuted common prefixes tell which
   windows repeat within it.
4. A name with more contents than ``PART_CONTENTS`` is split into parts, each
   a shard. What is open after that is compared across parts by counting, with
   partial counts before the shuffle: first the cores of blocks of windows,
   then the windows of blocks whose core repeats. So no name, however common,
   is gathered in one task.

Rules: null text is empty; texts shorter than ``length`` lose nothing; rows
without an id and repeated rows are texts of their own, so an exact copy of a
row counts as a repetition; an empty input gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.cuckoo import spread
from logloom.llm.frames import as_bytes, batched, doc_table, ranges, stored
from logloom.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH = 400
# Windows that are named at once, and bytes of a shard.
BLOCK_WINDOWS = 1 << 20
SHARD_BYTES = 1 << 19
PART_CONTENTS = 256
BASE = 0x9E3779B97F4A7C15
# Stands between contents; it never occurs in UTF-8.
GAP = b"\xff"
# Windows of a block.
STEP = 16
SPAN, BLOCK = 0, 1
FOUND = "kind int, w1 long, w2 long, doc long, tie long, first long, last long, left binary, right binary, have int, open int"


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse, modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    size = 1 << max(10, int(len(data) - 1).bit_length())
    up, down = powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        return spread((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def named_segments(chunk: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, name, and whether the name's gram comes twice,
    of each segment of a text of at least ``length`` bytes."""
    gram = max(1, length // 4)
    hashes = gram_hashes(np.frombuffer(chunk, np.uint8), gram)
    names = sliding_least(hashes, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    last = np.concatenate([first[1:], [len(names)]]) - 1
    name = names[first]
    # how often the name stands among the grams of its segment
    where = np.flatnonzero(np.isin(hashes, name))
    order = np.lexsort((where, hashes[where]))
    key, place = hashes[where][order], where[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    twice = np.zeros(len(first), bool)
    if len(again):
        doubled = {}
        for a, b, k in zip(place[again].tolist(), place[again + 1].tolist(), key[again].tolist()):
            doubled.setdefault(k, []).append((a, b))
        for i in np.flatnonzero(np.isin(name, key[again])).tolist():
            lo, hi = int(first[i]), int(last[i]) + length - gram
            twice[i] = any(lo <= a and b <= hi for a, b in doubled[int(name[i])])
    return first, last, name.view(np.int64), twice


def segments(docs: DataFrame, length: int) -> DataFrame:
    """``doc, tie, first, size, m, c1, c2, twice`` of every segment."""

    def work(batch: pa.RecordBatch) -> dict:
        import xxhash

        out: dict[str, list] = {k: [] for k in ("doc", "tie", "first", "size", "m", "c1", "c2", "twice")}
        for doc, tie, text in zip(batch["doc"].to_pylist(), batch["tie"].to_pylist(), as_bytes(batch["text"])):
            for start in range(0, len(text) - length + 1, BLOCK_WINDOWS):
                chunk = text[start : start + BLOCK_WINDOWS + length - 1]
                first, last, name, twice = named_segments(chunk, length)
                view, n = memoryview(chunk), len(first)
                digests = b"".join([xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())])
                pair = np.frombuffer(digests, "<i8").reshape(-1, 2)
                for k, v in zip(out, (np.full(n, doc), np.full(n, tie), first + start, last - first + length, name, pair[:, 0], pair[:, 1], twice)):
                    out[k].append(v)
        return {k: np.concatenate(v) if v else [] for k, v in out.items()}

    return batched(docs, work, "doc long, tie long, first long, size long, m long, c1 long, c2 long, twice boolean")


def pieces_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add the bytes to rows of ``doc, tie, first, size`` and other columns."""
    names = [c for c in wanted.columns if c not in ("doc", "tie")]
    types = {f.name: f.dataType.simpleString() for f in wanted.schema}
    per_doc = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct(*names)).alias("rows"))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc", "tie", *names, "bytes")}
        for doc, tie, text, rows in zip(batch["doc"].to_pylist(), batch["tie"].to_pylist(), as_bytes(batch["text"]), batch["rows"].to_pylist()):
            for r in rows:
                for k, v in zip(out, (doc, tie, *(r[n] for n in names), text[r["first"] : r["first"] + r["size"]])):
                    out[k].append(v)
        return out

    return batched(docs.join(per_doc, ["doc", "tie"]), cut, ", ".join(f"{k} {types[k]}" for k in ("doc", "tie", *names)) + ", bytes binary")


def repeats_within(contents: list[bytes], length: int) -> list[np.ndarray]:
    """Per content which of its windows start anywhere else among them."""
    text = np.frombuffer(GAP.join(contents), np.uint8)
    order = suffix_array(text)
    common = permuted_prefixes(text, order)[order]
    enough = common >= length
    found = np.zeros(len(text), bool)
    found[order] = enough | np.concatenate([enough[1:], [False]])
    starts = np.cumsum([0, *(len(c) + 1 for c in contents)])
    return [found[a : a + len(c) - length + 1] for a, c in zip(starts.tolist(), contents)]


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of marks."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def window_blocks(content: bytes, name: int, marks: np.ndarray, length: int):
    """Up to ``STEP`` neighbouring windows at a time, aligned to the name's
    gram: (place of the core, core, bytes left and right of it, bits of the
    windows there are, bits of those that are open yet).

    The core is what all windows of a full block share, so any of them holds
    it whole; a window of the block is its core, some bytes left of it and
    some right of it.
    """
    hashes = gram_hashes(np.frombuffer(content, np.uint8), max(1, length // 4))
    grams = np.flatnonzero(hashes.view(np.int64) == name)
    at = np.arange(len(marks))
    gram = grams[np.searchsorted(grams, at)]
    core = gram - (gram - at) // STEP * STEP
    cuts = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1], [True]])).tolist()
    for i, j in zip(cuts, cuts[1:]):
        c = int(core[i])
        have = sum(1 << (c - p) for p in range(i, j))
        opened = sum(1 << (c - p) for p in range(i, j) if not marks[p])
        end = c + length - STEP + 1
        yield c, content[c:end], content[max(0, c - STEP + 1) : c], content[end : end + STEP - 1], have, opened


def compared(shards: DataFrame, length: int) -> DataFrame:
    """Suffix arrays over shards of ``doc, tie, first, size, m, n, parts, bytes``.

    Spans of repeated windows come out for contents that occur once. From
    split names also come blocks of windows: those with open ones, and of each
    block whose windows all repeat already, one.
    """

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        out: list[tuple] = []
        contents = rows["bytes"].tolist()
        seen: set[bytes] = set()
        columns = (rows[c].tolist() for c in ("doc", "tie", "first", "m", "n", "parts"))
        for marks, content, doc, tie, first, m, n, parts in zip(repeats_within(contents, length), contents, *columns):
            if n == 1:
                out += [(SPAN, 0, 0, doc, tie, first + a, first + b, b"", b"", 0, 0) for a, b in zip(*(x.tolist() for x in runs(marks)))]
            if parts > 1:
                for at, core, left, right, have, opened in window_blocks(content, m, marks if n == 1 else np.ones_like(marks), length):
                    digest = xxhash.xxh3_128_digest(core)
                    whole = b"".join((digest, left, right, have.to_bytes(4)))
                    if opened or whole not in seen:
                        seen.add(whole)
                        out.append((BLOCK, *np.frombuffer(digest, "<i8").tolist(), doc, tie, first + at, 0, left, right, have, opened))
        return pd.DataFrame(out, columns=["kind", "w1", "w2", "doc", "tie", "first", "last", "left", "right", "have", "open"])

    return shards.groupBy("shard").applyInPandas(work, FOUND)


def repeated_across(blocks: DataFrame) -> DataFrame:
    """Open windows that another part holds as well.

    Only blocks whose core occurs twice are opened into windows, which are
    counted by core and the bytes beside it.
    """
    cores = blocks.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    j = F.col("j")
    windows = blocks.join(cores, ["w1", "w2"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(STEP - 1)))).where("(have >> j) & 1 = 1")
    windows = windows.select(
        "w1", "w2", "j", F.substring("left", F.octet_length("left") - j + 1, j).alias("l"), F.substring("right", F.lit(1), STEP - 1 - j).alias("r"),
        "doc", "tie", (F.col("first") - j).alias("first"), F.expr("(open >> j) & 1 = 1").alias("open"),
    )
    windows = stored(windows, "windows")
    name = ["w1", "w2", "j", "l", "r"]
    twice = windows.groupBy(*name).agg(F.count("*").alias("n")).where("n > 1").select(*name)
    return windows.where("open").join(twice, name).select("doc", "tie", "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, tie, first, last``: windows ``first`` to ``last`` of a text repeat.

    ``docs`` has ``doc, tie, text``.
    """
    if length < STEP:
        raise ValueError(f"length must be at least {STEP}")
    rows = stored(segments(docs, length), "segments")
    names = rows.groupBy("m").agg(F.count("*").alias("total"), F.max("twice").alias("any")).where("total > 1 OR any").select("m")
    some = stored(rows.join(names, "m"), "repeated")
    place = ("doc", "tie", "first", "size")
    contents = stored(some.groupBy("m", "c1", "c2").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), *(F.first(c).alias(c) for c in place)), "contents")
    kinds = contents.groupBy("m").agg(F.count("*").alias("kinds"), F.max("twice").alias("any")).where("kinds > 1 OR any")
    part = F.pmod(F.col("c1"), F.col("parts"))
    asked = contents.join(kinds.select("m", F.ceil(F.col("kinds") / PART_CONTENTS).alias("parts")), "m").withColumn("part", part)
    asked = stored(asked.select(*place, "m", "n", "parts", "part"), "asked")
    size = asked.where("parts = 1").agg(F.sum("size")).first()[0] or 0
    shard = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("m"), F.lit(max(1, size // SHARD_BYTES)))).otherwise(F.xxhash64("m", "part"))
    found = stored(compared(pieces_of(docs, asked.select(*place, "m", "n", "parts", shard.alias("shard"))), length), "found")
    twice = some.join(contents.where("n > 1").select("m", "c1", "c2"), ["m", "c1", "c2"]).select("doc", "tie", "first", (F.col("first") + F.col("size") - length).alias("last"))
    within = found.where(f"kind = {SPAN}").select("doc", "tie", "first", "last")
    return twice.unionByName(within).unionByName(repeated_across(found.where(f"kind = {BLOCK}")))


def merged(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (start, end) under spans of windows."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``; ``kept`` is binary, for a
    cut may fall inside a letter."""
    table = doc_table(docs).select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    spans = repeated_spans(table.select("doc", "tie", "text"), length)
    per_doc = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
        for text, spans in zip(as_bytes(batch["text"]), batch["spans"].to_pylist()):
            gone = merged([(s["first"], s["last"]) for s in spans or ()], length)
            ends = [0, *(x for span in gone for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
            for k, v in zip(out, (len(text), len(text) - len(kept), len(gone), kept)):
                out[k].append(v)
        return out | {"doc_id": batch["doc_id"]}

    joined = table.join(per_doc, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    return batched(joined, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
