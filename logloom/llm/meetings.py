"""Comparing all members of a key with each other, two blocks at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_least(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each row reaches through the links a-b of rows."""
    least = nodes.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        if (least == before).all():
            return least


def met_in_blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Deal the rows of each key into blocks by hash of ``node``; two blocks
    meet as ``x, y``, and ``own`` is the row's block. No meeting grows with
    the key. Meetings of keys of one block are gathered by some 2,000 rows,
    ``meeting`` names the group in which a row arrives."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("members"), F.ceil(F.count("*") / block).cast("int").alias("n"))
    placed = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("node", key), F.col("n")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return _dealt(placed, sizes, key).drop("n", "members")


def _dealt(placed: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    placed = placed.withColumn("x", F.least("own", "with")).withColumn("y", F.greatest("own", "with"))
    alone = sizes.where("n = 1").agg(F.sum("members")).first()[0] or 0
    groups = max(1, alone // 2000)
    few = F.pmod(F.xxhash64(key), F.lit(groups))
    return placed.withColumn("meeting", F.when(F.col("n") == 1, few).otherwise(F.xxhash64(key, "x", "y"))).drop("with")


def strangers_in_blocks(rows: DataFrame, key: str, label: str, block: int) -> DataFrame:
    """As :func:`met_in_blocks`, where only members of different labels have to
    meet. The members of a key's largest label are dealt into blocks of their
    own, which meet the blocks of all others and never each other. So a key
    with one large label and few others is compared in proportion to its
    members. A key of one block meets as a whole."""
    parts = rows.groupBy(key, label).agg(F.count("*").alias("c"))
    sizes = parts.groupBy(key).agg(F.sum("c").alias("members"), F.max(F.struct("c", label)).alias("top"))
    others = F.when(F.col("members") <= block, 1).otherwise(F.ceil((F.col("members") - F.col("top.c")) / block)).cast("int")
    main = F.when(F.col("members") <= block, 0).otherwise(F.ceil(F.col("top.c") / block)).cast("int")
    sizes = sizes.select(key, "members", F.col(f"top.{label}").alias("top"), others.alias("others"), main.alias("main"), (others + main).alias("n"))
    placed = rows.join(sizes, key).withColumn("is_main", (F.col("main") > 0) & (F.col(label) == F.col("top")))
    spread = F.pmod(F.xxhash64("node", key), F.when(F.col("is_main"), F.col("main")).otherwise(F.col("others")))
    placed = placed.withColumn("own", (spread + F.when(F.col("is_main"), F.col("others")).otherwise(0)).cast("int"))
    last = F.when(F.col("is_main"), F.col("others")).otherwise(F.col("n")) - 1
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return _dealt(placed, sizes, key).drop("members", "top", "others", "main", "n", "is_main")


def each_meeting(rows: pd.DataFrame, key: str) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """The meetings in a group: key, rows sorted by node, and the mask of the
    pairs that this meeting has to look at."""
    for (name, x, y), part in rows.sort_values("node").groupby([key, "x", "y"], sort=False):
        own = part["own"].to_numpy()
        yield name, part, np.triu(np.ones((len(part),) * 2, bool) if x == y else own[:, None] != own[None, :], 1)
