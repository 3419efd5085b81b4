"""Quality classifier: histogram gradient-boosted trees over text statistics.

Statistics of every whole text are computed once on the executors and stored
as a narrow table. A sample of labelled rows, chosen by hash so that some
``TRAIN_ROWS`` are expected, trains the trees in numpy: statistics are cut into at
most ``BINS`` bins, and each level of a tree is found from one histogram of
gradients. The trees are complete and of one depth, flattened into arrays, so
that scoring walks all rows and one level at a time in numpy.

Rules: null text is empty (all statistics zero) and gets a score like any
other; labels, language, source and id are no inputs; rows without a label or
with a null one don't train; without any labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.doc_stats import FEATURES, features
from logloom.llm.frames import as_bytes, batched, doc_table, stored

TRAIN_ROWS = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
RIDGE = 1.0
# Split gain below which a node stays whole.
LEAST_GAIN = 1e-6


@dataclass
class Forest:
    """Trees as arrays: node n of a tree has children 2n + 1 and 2n + 2."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    limit: np.ndarray  # values up to the limit go left
    value: np.ndarray  # trees x 2**depth

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(rows), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (rows[at_row, feature[node]] > limit[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def bin_edges(rows: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in rows.T]


def train(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Newton boosting on the logistic loss; ties go to the first split."""
    n, width = rows.shape
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(0.0, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if not n or labels.min() == labels.max():
        forest.base = 0.0 if not n else float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
        return forest
    edges = bin_edges(rows, bins)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T)], axis=1)
    cell = binned + bins * np.arange(width)
    usable = np.arange(bins)[None, :] < np.array([len(e) for e in edges])[:, None]
    mean = labels.mean()
    forest.base = float(np.log(mean / (1 - mean)))
    total = np.full(n, forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = p - labels, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            here, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (width * bins) + cell).ravel()
            size = here * width * bins
            g, h = (np.bincount(key, np.repeat(v, width), size).reshape(here, width, bins).cumsum(axis=2) for v in (gradient, curve))
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain = np.where(usable, gain, -1.0).reshape(here, -1)
            best = gain.argmax(axis=1)
            for k, b in enumerate(best):
                if gain[k, b] > LEAST_GAIN:
                    f, cut = divmod(int(b), bins)
                    forest.feature[t, first + k], forest.limit[t, first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (rows[np.arange(n), forest.feature[t, node]] > forest.limit[t, node])
        leaf = node - inner
        g, h = (np.bincount(leaf, v, leaves) for v in (gradient, curve))
        forest.value[t] = -rate * g / (h + RIDGE)
        total += forest.value[t][leaf]
    return forest


def feature_table(docs: DataFrame) -> DataFrame:
    """``doc_id, stats array<double>`` of each whole text."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "stats": [features(t) for t in as_bytes(batch["text"])]}

    return batched(doc_table(docs), work, "doc_id long, stats array<double>")


def held_out(column: str = "doc_id"):
    """Documents that never train: the CRC of their id's text divides by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(table: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Forest:
    """Train on some ``train_rows`` labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = 1_000_000 * train_rows // max(1, known.count())
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows = sorted((r.doc_id, tuple(r.stats), r.label) for r in table.join(few, "doc_id").select("doc_id", "stats", "label").toLocalIterator())
    if not rows:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    return train(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def scored(table: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return {"doc_id": batch["doc_id"], "score": forest.scores(rows)}

    marked = batched(table.select("doc_id", "stats"), work, "doc_id long, score double")
    return marked.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the labels and score every document."""
    table = stored(feature_table(docs), "features")
    return scored(table, fit(table, labels, train_rows=train_rows), threshold)
