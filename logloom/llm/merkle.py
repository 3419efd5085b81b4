"""A Merkle tree over a data set, by slot pivots.

Each row is a leaf, the digest of its fields. Within a group (a language)
leaves stand in order; every ``FANOUT`` consecutive nodes become the digest of
their joined digests until one is left, the group's subroot. Subroots in order
of their groups become the root in the same way.

A level is one aggregation: conditional aggregates spread the children of a
parent into ``FANOUT`` slot columns. The joined slots hash to the parent; the
joined slots left and right of a child's own are its siblings. Downwards, a
parent hands each child its own path and the child's siblings on either side,
so one join a level, from few nodes to many, gives every leaf its whole path.
Leaves never join: the pivot of their level holds all that a row needs.

Places come from a range partitioning and one small row per partition, so no
group, however large, is numbered in one task.

Rules: a null field counts as ``-``, any other as its UTF-8 length, a colon
and its value. A null group is a group and comes first; rows without an id
come last in their group, rows of one id in order of their digests. Rows
without an id are never tampered with. Repeated rows are leaves of their own.
An empty input gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.frames import stored
from logloom.sources.workspace import broadcast_if_small

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows of one partition of a stored, numbered table share these bits.
PLACE_BITS = 33


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``place``, 0 to rows - 1 in the given order.

    The rows are dealt by ranges and written sorted. ``order`` should end in
    something that tells rows apart, so that no range is one value.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", PLACE_BITS)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row per partition
    before = stored(sizes.select("part", (F.expr("sum(n) OVER (ORDER BY part)") - F.col("n")).alias("before")), f"{name}_parts")
    inside = F.col("at") - F.shiftleft(part, PLACE_BITS)
    return rows.join(broadcast_if_small(before), part == F.col("part")).withColumn("place", F.col("before") + inside).drop("at", "part", "before")


def leaves(docs: DataFrame, fields: tuple[str, ...], id_col: str, group_col: str, text_col: str) -> DataFrame:
    """``doc_id, lang, leaf, changed, row``: digests as they are and after
    tampering; ``changed`` is null where nothing is tampered with."""
    values = {c: docs[c] for c in fields}
    altered = values | {text_col: F.translate(docs[text_col], UPPER, LOWER)}
    doc_id = docs[id_col].cast("long")
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return docs.select(
        doc_id.alias("doc_id"), docs[group_col].cast("string").alias("lang"), digest(*map(field, values.values())).alias("leaf"),
        F.when(tampered, digest(*map(field, altered.values()))).alias("changed"), F.monotonically_increasing_id().alias("row"),
    )


def pivot(nodes: DataFrame, slots: list[str], fanout: int) -> DataFrame:
    """One row per run of ``fanout`` nodes: ``g, place, n``, the columns of
    ``slots`` spread over slots, and the parent's ``hash``.

    ``nodes`` has ``g, place, n, hash``; ``n`` is the count of nodes of the
    group's level.
    """
    slot = F.pmod("place", F.lit(fanout))
    spread = [F.max(F.when(slot == k, F.col(c))).alias(f"{c}{k}") for c in slots for k in range(fanout)]
    up = nodes.groupBy("g", F.floor(F.col("place") / fanout).alias("place"), F.ceil(F.col("n") / fanout).alias("n")).agg(*spread)
    return up.withColumn("hash", F.sha2(F.concat_ws("", *(f"hash{k}" for k in range(fanout))).cast("binary"), 256))


def siblings(k: int, fanout: int) -> Column:
    """What stands left and right of slot ``k``."""
    beside = lambda slots: F.concat_ws("", *(f"hash{i}" for i in slots)) if slots else F.lit("")
    return F.struct(beside(range(k)).alias("left"), beside(range(k + 1, fanout)).alias("right"))


def children(parents: DataFrame, keep: list[str], own: list[str], fanout: int) -> DataFrame:
    """Rows of a pivot with the parent's ``path``, as one row per child:
    ``keep``, the child's ``own`` columns, ``slot`` and its own ``path``."""
    child = [F.struct(F.lit(k).alias("slot"), F.concat(F.array(siblings(k, fanout)), "path").alias("path"), *(F.col(f"{c}{k}").alias(c) for c in ["hash", *own])) for k in range(fanout)]
    return parents.select(*keep, F.explode(F.array(*child)).alias("c")).where("c.hash IS NOT NULL").select(*keep, "c.*")


def climb(nodes: DataFrame, height: int, slots: list[str], fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Pivots of all levels, lowest first, and the node left of each group.

    A group that is down to one node waits while others go on.
    """
    levels, done = [], []
    for level in range(height):
        done.append(nodes.where("n = 1").select("g", "hash"))
        levels.append(stored(pivot(nodes.where("n > 1"), slots if level == 0 else ["hash"], fanout), f"{name}{level}"))
        nodes = levels[-1].select("g", "place", "n", "hash")
    return levels, reduce(DataFrame.unionByName, [*done, nodes.select("g", "hash")])


def height_of(most: int, fanout: int) -> int:
    levels = 0
    while most > 1:
        most, levels = -(-most // fanout), levels + 1
    return levels


def descend(levels: list[DataFrame], tops: DataFrame, carry: list[str], fanout: int, name: str) -> DataFrame:
    """The lowest pivot with the path and the carried columns of each parent.

    ``tops`` has ``g, path`` and what is carried, one row per group. The
    frame of a group's own top level joins ``tops``; all below it join the
    level above.
    """
    above = None
    for level in reversed(levels):
        first = level.where("n = 1").join(tops, "g")
        if above is not None:
            first = first.unionByName(level.where("n > 1").join(above, ["g", "place"]))
        if level is levels[0]:
            return first
        grown = children(first, ["g", "place", *carry], [], fanout)
        above = stored(grown.select("g", (F.col("place") * fanout + F.col("slot")).alias("place"), "path", *carry), name)
    raise ValueError("a tree of no levels has no parents")


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fanout: int = FANOUT
) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, changed``, one row per document.

    ``path`` is an array of (left, right) from the leaf's level to the root:
    the joined digests of the siblings on either side.
    """
    rows = stored(leaves(docs, fields, id_col, group_col, text_col), "leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), F.col("leaf"), F.col("row")]
    placed = numbered(rows, order, "placed_leaves")
    groups = stored(placed.groupBy("lang").agg(F.min("place").alias("start"), F.count("*").alias("n")), "group_sizes")
    # rows are in order of their groups, so the start of a group ranks it
    groups = stored(numbered(groups, [F.col("start")], "groups").withColumnRenamed("place", "g"), "ranked_groups")
    bounds = groups.agg(F.max("n").alias("rows"), F.count("*").alias("groups")).first()
    nodes = placed.join(broadcast_if_small(groups), placed["lang"].eqNullSafe(groups["lang"]))
    nodes = nodes.select("g", (F.col("place") - F.col("start")).alias("place"), "n", F.col("leaf").alias("hash"), "doc_id", "changed")
    # a group of one row has no run: its leaf is its subroot
    height = height_of(bounds["rows"] or 0, fanout)
    levels, subroots = climb(nodes, height, ["hash", "doc_id", "changed"], fanout, "level")
    tops = subroots.select(F.lit(0).alias("g"), F.col("g").alias("place"), F.lit(bounds["groups"]).cast("long").alias("n"), "hash")
    upper, root = climb(tops, height_of(bounds["groups"], fanout), ["hash"], fanout, "upper")
    path = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    root = root.select("g", path, F.col("hash").alias("root"))
    if upper:
        top = children(descend(upper, root, ["root"], fanout, "upper_paths"), ["place", "root"], [], fanout)
        groups_path = top.select((F.col("place") * fanout + F.col("slot")).alias("g"), "path", F.col("hash").alias("subroot"), "root")
    else:
        groups_path = root.select(F.lit(0).cast("long").alias("g"), "path", F.col("root").alias("subroot"), "root")
    groups_path = stored(groups_path, "group_paths")
    out = ["doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", "changed"]
    lone = nodes.where("n = 1").join(groups_path, "g").select(*out)
    if not levels:
        return lone
    runs = descend(levels, groups_path, ["subroot", "root"], fanout, "paths")
    return children(runs, ["subroot", "root"], ["doc_id", "changed"], fanout).select(*out).unionByName(lone)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, p: digest(p["left"], node, p["right"]))


def verified(tree: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``:
    each document checked after tampering against the stored siblings."""
    checked = tree.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
