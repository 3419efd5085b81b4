"""Packing documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents, and attention cost (the
sum of squared piece lengths). A piece goes to the open sequence that scores
best among those where it fits every capacity: the least norm of what would be
left (``norm``), or the largest weighted dot product of the piece's needs and
the room (``dot``). Pieces come largest first.

Only numbers move: texts are tokenised where they lie, and a row of some
40 bytes per piece is dealt by hash into groups of ``GROUP_PIECES`` on
average, each packed alone. A group costs at most a fraction of a sequence;
no key of the data steers the dealing, so no group is hot.

Rules: null text is empty (one piece, the end id); repeated rows are packed
once each and told apart by ``row``; null ids are packed too; an empty input
gives no rows. A piece never exceeds the token capacity; a piece that fits no
sequence because of its attention cost alone gets its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.frames import batched, doc_table, stored
from logloom.llm.word_tokens import WORD_BPE, encoder

GROUP_PIECES = 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, tokenizer: str = WORD_BPE, end_id: int = 0) -> DataFrame:
    """Cut token ids (end id included) at multiples of ``capacity``."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        ids = encoder(tokenizer).encode(batch["text"])
        for doc_id, raw in zip(batch["doc_id"].to_pylist(), ids):
            raw = memoryview(raw + end)
            for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                for k, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[k].append(v)
        return out

    return batched(doc_table(docs), cut, PIECES, uses=(encoder,))


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    limit, weight = np.asarray(capacity, float), np.asarray(weights, float)
    room = np.empty((len(lengths), 3))
    bins = np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = float(lengths.min(initial=1))
    open_, made = 0, 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        here = room[:open_]
        fits = np.flatnonzero((here >= need).all(axis=1))
        if len(fits):
            if score == "norm":
                value = (weight * ((here[fits] - need) / limit) ** 2).sum(axis=1)
            else:
                value = -(weight * (need / limit) * (here[fits] / limit)).sum(axis=1)
            at = fits[np.argmin(value)]
        else:
            at = open_
            room[at], bins[at] = limit, made
            open_, made = open_ + 1, made + 1
        number[i], offset[i] = bins[at], capacity[0] - room[at, 0]
        room[at] -= need
        if room[at, 0] < least or room[at, 1] < 1:  # full: the last open one takes its place
            open_ -= 1
            room[at], bins[at] = room[open_], bins[open_]
    return number, offset


def pack(table: DataFrame, capacity: int, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "norm") -> DataFrame:
    """Add ``row, sequence_id, offset`` to ``pieces``.

    Without limits of its own, a sequence may hold ``capacity`` documents and
    ``capacity`` squared of attention cost, which the token capacity implies.
    """
    limits = (float(capacity), float(max_docs or capacity), float(max_attention or capacity**2))
    table = stored(table.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-table.count() // GROUP_PIECES))
    dealt = table.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)))
    schema = f"{PIECES}, row long, sequence_id long, offset long"

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "piece"], kind="stable")
        number, offset = best_fit(rows["length"].to_numpy(), limits, weights, score)
        rows["sequence_id"], rows["offset"] = number * groups + key[0], offset
        return rows.drop(columns="group")

    return dealt.groupBy("group").applyInPandas(fill, schema)


def packed(docs: DataFrame, capacity: int = 2048, tokenizer: str = WORD_BPE, end_id: int = 0, **limits) -> DataFrame:
    """Whole documents to packed pieces."""
    return pack(pieces(docs, capacity, tokenizer, end_id), capacity, **limits)
