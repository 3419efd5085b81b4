"""Template mining.

The rule is greedy and depends on order: a message joins the most similar
template of its length (the earliest on ties) when at least ``threshold`` of
its words agree, else it starts one; words that differ become wildcards.

Four facts make that a set of Spark jobs with little sequential work:

1. Only templates of the same word count compete.
2. A message that a template covers fully (every word equal or wildcard)
   never changes any template, and stays covered for good. So the only
   messages to replay in order are the distinct masked ones that no template
   covers at their time.
3. Messages and templates that share no word at any position, not even through
   others, never meet, unless a template has so many wildcards that it takes
   any message (a *catch-all*).
4. A row belongs to the earliest template that covers it at its place in the
   order, whichever way the templates came about.

So: find distinct masked messages; take a bounded batch of uncovered ones per
word count, with the templates that any of them could join; split it into
groups that share no word; replay the groups in parallel. What a group made
holds up to the place where the first catch-all came up; what is later goes
back. Drop what the templates now cover, repeat until nothing is left. Then
assign rows by the same coverage and by order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logloom import fixed_values as fv
from logloom.functions import templates as tf
from logloom.functions.capture import evaluate_once
from logloom.functions.normalize import is_error, text_or_null, timestamp_text
from logloom.schema import ORDER
from logloom.sources.workspace import broadcast_if_small, drop_dir, settle, store, stored, temporary

# Most messages and words of one word count that a batch takes, and most
# messages where a catch-all keeps them in one group.
BATCH_ROWS = 16_000
BATCH_WORDS = 2_000_000
CATCH_ALL_ROWS = 1_000
# Messages are counted off by this many.
STRIDE = 256
# Templates that one task compares with a batch.
CHUNK_TEMPLATES = 16_000
# Comparisons of a word that take as long as listing and looking up one.
LISTED_COST = 2_500


# --- exact signatures -----------------------------------------------------------


def with_signature(logs: DataFrame) -> DataFrame:
    return evaluate_once(logs, "signature", tf.signature(F.col("message")))


def signature_counts(logs: DataFrame) -> DataFrame:
    """Distinct masked messages with size, errors, first and last time and place."""
    rows = with_signature(logs).select("signature", "level", "ts", *ORDER)
    dated = lambda pick: pick(F.when(F.col("ts").isNotNull(), F.col("line_number")))
    per_source = rows.groupBy("signature", "source").agg(
        F.count("*").alias("size"),
        F.count_if(is_error(F.col("level"))).alias("error_count"),
        F.min("line_number").alias("line_number"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_number"))).alias("first_ts"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_number"))).alias("last_ts"),
        dated(F.min).alias("first_dated"),
    )
    in_source = F.when(F.col("first_dated").isNotNull(), F.col("source"))
    return per_source.groupBy("signature").agg(
        F.sum("size").alias("size"),
        F.sum("error_count").alias("error_count"),
        F.min(F.struct(*ORDER)).alias("first_ord"),
        F.min_by("first_ts", in_source).alias("first_seen"),
        F.max_by("last_ts", in_source).alias("last_seen"),
    )


def rank_by_order(df: DataFrame, order: tuple[str, ...], name: str, base: int = 0) -> DataFrame:
    """Number rows ``base + 1, ..`` in order, by range partitions instead of one task."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("_id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row per partition.
    sizes = sizes.select("_part", "_first", before.alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    rank = F.lit(base + 1) + F.col("_before") + F.col("_id") - F.col("_first")
    return numbered.withColumn(name, rank).drop("_id", "_part", "_first", "_before")


# --- coverage -------------------------------------------------------------------


def match_templates(signatures: DataFrame, templates: DataFrame) -> DataFrame:
    """All (signature row, template row) pairs where the template covers the signature.

    Both sides need ``n_tokens`` and ``tokens``. A template without wildcards
    is looked up by its text. Any other is filed under its rarest word and
    that word's position; a signature covered by it has that word there. So a
    signature asks once per position that templates of its length are filed
    under, and meets only templates that share a word with it. Templates of
    wildcards alone are filed under their length.
    """
    keyed = templates.withColumn("_wild", F.array_contains("tokens", fv.WILDCARD))
    keyed = stored(keyed.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    plain = keyed.where("not _wild").withColumn("_text", F.array_join("tokens", " ")).drop("tokens", "_wild", "_row")
    exact = signatures.withColumn("_text", F.array_join("tokens", " ")).drop("tokens")
    exact = exact.join(broadcast_if_small(plain), ["n_tokens", "_text"]).drop("_text")
    words = keyed.where("_wild").select("_row", "n_tokens", F.posexplode("tokens").alias("_at", "_word")).where(F.col("_word") != fv.WILDCARD)
    common = words.groupBy("n_tokens", "_at", "_word").agg(F.count("*").alias("_n"))
    rarest = words.join(common, ["n_tokens", "_at", "_word"]).groupBy("_row").agg(F.min(F.struct("_n", "_at", "_word")).alias("_key"))
    filed = keyed.where("_wild").join(rarest, "_row", "left").drop("_row", "_wild").withColumnRenamed("tokens", "_tokens")
    filed = filed.withColumn("_at", F.coalesce("_key._at", F.lit(-1))).withColumn("_word", F.coalesce("_key._word", F.lit(""))).drop("_key")
    filed = stored(filed, "filed")
    places = filed.groupBy("n_tokens").agg(F.collect_set("_at").alias("_places"))  # no more than words in a message
    asked = signatures.join(broadcast_if_small(places), "n_tokens").withColumn("_at", F.explode("_places")).drop("_places")
    asked = asked.withColumn("_word", F.coalesce(F.get("tokens", F.when(F.col("_at") >= 0, F.col("_at"))), F.lit("")))
    met = asked.join(broadcast_if_small(filed), ["n_tokens", "_at", "_word"])
    covers = F.forall(F.zip_with("tokens", "_tokens", lambda x, y: (y == fv.WILDCARD) | (x == y)), lambda x: x)
    return exact.unionByName(met.where(covers).drop("tokens", "_tokens", "_at", "_word"))


# --- mining ---------------------------------------------------------------------


@dataclass
class MinedTemplates:
    """``versions``: every state of every template, with the place it came up.
    ``clusters``: the number of each template. ``signatures``: the distinct
    masked messages of the last run; ``new_versions`` and ``new_clusters``:
    what that run added."""

    versions: DataFrame
    clusters: DataFrame
    signatures: DataFrame | None = None
    order: tuple[str, ...] = field(default=ORDER)
    new_versions: DataFrame | None = None
    new_clusters: DataFrame | None = None

    def numbered(self) -> DataFrame:
        return self.versions.join(self.clusters, ["n_tokens", "cluster"]).drop("cluster")

    def latest(self) -> DataFrame:
        """(template_id, n_tokens, tokens, template): the present templates."""
        now = F.max_by("tokens", "version").alias("tokens")
        latest = self.numbered().groupBy("template_id", "n_tokens").agg(now)
        return latest.withColumn("template", F.array_join("tokens", " "))


def _versions_schema(order_fields: list[T.StructField]) -> T.StructType:
    return T.StructType(
        [
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("cluster", T.LongType()),
            T.StructField("version", T.IntegerType()),
            T.StructField("tokens", T.ArrayType(T.StringType())),
            *order_fields,
        ]
    )


class _Grid:
    """Templates of one word count as rows of word codes.

    A line is compared with all rows at once. Where those are many (``indexed``),
    rows are listed by position and word instead: one that agrees with a line on
    ``need`` of its words agrees on at least one of any ``width - need + 1``
    positions, so only those listed at the positions with the shortest lists
    are compared.
    """

    def __init__(self, width: int, need: int, room: int, wild: int, indexed: bool):
        self.width, self.need, self.wild = width, need, wild
        self.cells = np.zeros((room, width), dtype=np.int32)
        self.open = np.zeros((room, width), dtype=bool)
        self.version = np.zeros(room, dtype=np.int64)
        self.used = 0
        self.listed: list[dict[int, list[int]]] | None = [{} for _ in range(width)] if indexed and width and need else None

    def put(self, row: int, line: np.ndarray, version: int) -> None:
        if self.listed is not None:
            for at in np.flatnonzero(self.cells[row] != line) if row < self.used else range(self.width):
                self.listed[at].setdefault(int(line[at]), []).append(row)
        self.cells[row], self.open[row], self.version[row] = line, line == self.wild, version
        self.used = max(self.used, row + 1)

    def alike(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that agree with a line on ``need`` words at least, and on how many."""
        if self.listed is None:
            rows = np.arange(self.used)
            agreeing = (self.cells[: self.used] == line) | self.open[: self.used]
        else:
            lists = [
                held.get(code, []) + (held.get(self.wild, []) if code != self.wild else [])
                for held, code in zip(self.listed, line.tolist())
            ]
            lists = sorted(lists, key=len)[: self.width - self.need + 1]
            rows = np.unique(np.array([row for some in lists for row in some], dtype=np.int64))
            agreeing = (self.cells[rows] == line) | self.open[rows]
        agree = np.bitwise_count(np.packbits(agreeing, axis=1)).sum(axis=1, dtype=np.int64)
        enough = agree >= self.need
        return rows[enough], agree[enough]

    def best(self, line: np.ndarray) -> int:
        """The most similar template, the earliest on ties, or -1."""
        rows, agree = self.alike(line)
        return int(rows[agree.argmax()]) if len(rows) else -1


def _many(rows: int, lines: int) -> bool:
    """Whether so many rows meet so many lines that listing words takes less
    time than comparing each with each."""
    return rows * lines > LISTED_COST * (rows + lines)


def _need(threshold: float) -> Column:
    """Words of a message that must agree with a template."""
    return F.ceil(F.lit(threshold) * F.col("n_tokens")).cast("int")


def _coded(*tables: pa.Table) -> tuple[list[np.ndarray], pa.Array, int]:
    """Words of tables as rows of numbers, the words they stand for, and the
    number of the wildcard (-1 if there is none)."""
    width = tables[0]["n_tokens"][0].as_py() if len(tables[0]) else 0
    texts = pa.chunked_array([c for t in tables for c in t["text"].chunks], pa.string())
    words = pc.list_flatten(pc.split_pattern(texts if width else texts.slice(0, 0), " "))
    numbered = words.combine_chunks().dictionary_encode()
    codes = numbered.indices.to_numpy(zero_copy_only=False).reshape(len(texts), width)
    wild = numbered.dictionary.index(fv.WILDCARD).as_py()
    return np.split(codes, np.cumsum([len(t) for t in tables])[:-1]), numbered.dictionary, wild


def _near(known: pa.Table, batch: pa.Table) -> pa.Table:
    """The templates that some message of the batch agrees with enough. No
    other can be chosen, nor change before it is."""
    if not len(known) or not len(batch):
        return known.slice(0, 0)
    (cells, lines), _, wild = _coded(known, batch)
    grid = _Grid(cells.shape[1], known["need"][0].as_py(), len(cells), wild, _many(len(cells), len(lines)))
    for row, line in enumerate(cells):
        grid.put(row, line, 0)
    chosen = np.zeros(len(cells), bool)
    for line in lines:
        chosen[grid.alike(line)[0]] = True
    return known.filter(pa.array(chosen))


def _groups(rows: pa.Table) -> pa.Table:
    """Add ``part``: rows of one word count that share a word at a position,
    directly or through others, are one part; all are where there is a catch-all."""
    (cells,), _, wild = _coded(rows)
    n, width = cells.shape
    part = np.arange(n)
    if ((cells == wild).sum(axis=1) >= rows["need"][0].as_py()).any():
        part[:] = 0
    elif width:
        _, key = np.unique(cells + np.arange(width, dtype=np.int64) * (int(cells.max()) + 1), return_inverse=True)
        key, plain = key.reshape(n, width), cells != wild
        while True:
            least = np.full(key.max() + 1, n)
            np.minimum.at(least, key[plain], np.broadcast_to(part[:, None], key.shape)[plain])
            new = np.minimum(part, np.where(plain, least[key], n).min(axis=1))
            new = new[new]
            if (new == part).all():
                break
            part = new
    return rows.append_column("part", pa.array(part, pa.int64())).append_column("parts", pa.array(np.full(n, len(np.unique(part))), pa.int64()))


def _replay(order: tuple[str, ...], schema: pa.Schema):
    """The greedy rule over the messages of one part, in order."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cluster")
        (cells,), words, wild = _coded(rows)
        need, parts = rows["need"][0].as_py(), rows["parts"][0].as_py()
        old, numbers, versions = (rows[c].to_pylist() for c in ("old", "cluster", "version"))
        if wild < 0:
            wild, words = len(words), pa.concat_arrays([words, pa.array([fv.WILDCARD], pa.string())])
        grid, owner, out = _Grid(cells.shape[1], need, len(cells), wild, _many(len(cells), len(cells) - sum(old))), [], []
        for row in sorted(range(len(old)), key=lambda i: (not old[i], numbers[i])):
            line, number, version = cells[row], numbers[row], versions[row]
            if not old[row]:
                at = grid.best(line)
                if at < 0:
                    version = 0
                else:
                    line = np.where(grid.cells[at] == line, line, wild)
                    if (line == grid.cells[at]).all():
                        continue
                    version = int(grid.version[at]) + 1
                    grid.put(at, line, version)
                    number = owner[at]
                out.append((row, number, version, line))
            if old[row] or version == 0:
                grid.put(grid.used, line, version)
                owner.append(number)
        lines = np.array([o[3] for o in out], np.int64).reshape(len(out), cells.shape[1])
        flat = words.take(pa.array(lines.ravel(), pa.int64()))
        tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * cells.shape[1], pa.int32()), flat)
        from_ = rows.take(pa.array([o[0] for o in out], pa.int64()))
        wilds = (lines == wild).sum(axis=1)
        columns = {
            "n_tokens": from_["n_tokens"], "cluster": pa.array([o[1] for o in out], pa.int64()), "version": pa.array([o[2] for o in out], pa.int32()), "tokens": tokens,
            **{c: from_[c] for c in order}, "at": from_["cluster"], "catches": pa.array((wilds >= need) & (parts > 1), pa.bool_()),
        }
        return pa.table(columns).cast(schema)

    return run


def _uncovered(signatures: DataFrame, latest: DataFrame) -> DataFrame:
    covered = match_templates(signatures.select("sig_id", "n_tokens", "tokens"), latest.select("n_tokens", "tokens"))
    return signatures.join(covered.select("sig_id").distinct(), "sig_id", "left_anti")


def _state(versions: DataFrame, messages: DataFrame, threshold: float) -> DataFrame:
    """The present templates of the word counts that ``messages`` have."""
    widths = F.broadcast(messages.select("n_tokens").distinct())  # a row per word count
    latest = versions.join(widths, "n_tokens", "left_semi").groupBy("n_tokens", "cluster").agg(
        F.max_by("tokens", "version").alias("tokens"), F.max("version").alias("version")
    )
    wilds = F.size(F.filter("tokens", lambda x: x == fv.WILDCARD))
    return latest.withColumn("need", _need(threshold)).withColumn("catches", wilds >= F.col("need"))


def _distinct_signatures(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Distinct signatures with the place each is first seen, as a stored
    table; ``sig_id`` counts them by word count and place."""
    *outer, inner = order
    per_file = rows.groupBy("signature", *outer).agg(F.min(inner).alias(inner))
    first = per_file.groupBy("signature").agg(F.min(F.struct(*order)).alias("o")).select("signature", "o.*")
    first = first.withColumn("n_tokens", tf.n_tokens(F.col("signature")).cast("int"))
    unranked = store(first, "first_seen")
    ranked = rank_by_order(rows.sparkSession.read.schema(first.schema).parquet(unranked), ("n_tokens", *order), "sig_id")
    drop_dir(rows.sparkSession, unranked)
    return ranked.select("sig_id", "n_tokens", tf.tokens_of(F.col("signature")).alias("tokens"), *order)


def _next_batch(remaining: DataFrame, catching: DataFrame, batch_rows: int, batch_words: int, stride: int) -> DataFrame:
    """``n_tokens, upto``: where the next batch of each word count ends, so that
    it keeps its bounds, or has a stride of rows at least."""
    strides = remaining.groupBy("n_tokens", F.floor(F.col("sig_id") / stride).alias("stride")).agg(F.count("*").alias("n"))
    strides = strides.join(catching.withColumn("catching", F.lit(True)), "n_tokens", "left")
    rows = F.sum("n").over(W.partitionBy("n_tokens").orderBy("stride"))
    most = F.least(
        F.when(F.col("catching"), min(CATCH_ALL_ROWS, batch_rows)).otherwise(batch_rows), F.lit(batch_words) / F.greatest("n_tokens", F.lit(1))
    )
    strides = strides.withColumn("fits", (rows <= most) | (F.col("n") == rows))
    return strides.where("fits").groupBy("n_tokens").agg(((F.max("stride") + 1) * stride).alias("upto"))


def _grouped(state: DataFrame | None, batch: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Messages of a batch and the templates that they may join, in parts.

    Words travel as one text, which costs far less than a list of them.
    """
    fields = ["n_tokens", "need", "cluster", "version", F.array_join("tokens", " ").alias("text")]
    rows = batch.withColumn("version", F.lit(0)).select(*fields, *order, F.lit(False).alias("old"))
    if state is not None:
        known = state.join(F.broadcast(batch.select("n_tokens").distinct()), "n_tokens", "left_semi")
        known = known.select(*fields, *(F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in order), F.lit(True).alias("old"))
        chunks = known.groupBy("n_tokens").agg(F.ceil(F.count("*") / CHUNK_TEMPLATES).cast("int").alias("chunks"))
        chunks = settle(chunks)
        # Of one type on both sides: equal numbers of two types hash apart.
        chunk = F.pmod(F.xxhash64("cluster"), F.col("chunks")).cast("int")
        known = known.join(broadcast_if_small(chunks), "n_tokens").withColumn("chunk", chunk).drop("chunks")
        asked = rows.join(broadcast_if_small(chunks), "n_tokens").select(
            F.col("n_tokens").alias("width"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_of"), "text"
        )
        near = known.groupBy("n_tokens", "chunk").cogroup(asked.groupBy("width", "chunk_of")).applyInArrow(_near, known.schema)
        rows = rows.unionByName(near.drop("chunk"))
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("parts", T.LongType())])
    return stored(rows.groupBy("n_tokens").applyInArrow(_groups, schema), "parts")


def mine_templates(
    logs: DataFrame,
    threshold: float = 0.5,
    known: MinedTemplates | None = None,
    order: tuple[str, ...] = ORDER,
    batch_rows: int = BATCH_ROWS,
    batch_words: int = BATCH_WORDS,
    stride: int = STRIDE,
) -> MinedTemplates:
    """Mine the templates of ``logs``; ``known`` ones are kept and extended.

    A round takes at most ``batch_rows`` messages and ``batch_words`` words of
    each word count, counted off by ``stride``. No task holds the messages or
    the templates of a word count, only a batch and what it can meet.
    """
    signatures = _distinct_signatures(with_signature(logs).select("signature", *order), order)
    schema = _versions_schema([signatures.schema[c] for c in order])
    spark = logs.sparkSession
    versions = spark.createDataFrame([], schema) if known is None else known.versions
    # Numbers of founding messages go on after those of earlier runs.
    base = 0 if known is None else versions.agg(F.coalesce(F.max("cluster"), F.lit(0)).alias("m")).first().m
    # Paths of the tables that rounds hand on; all else that a round stores is
    # deleted at its end, so scratch space does not grow with the rounds.
    left_at, state_at, added_at = None, None, []

    def read(path: str, like: DataFrame) -> DataFrame:
        return spark.read.schema(like.schema).parquet(path)

    state, remaining = None, signatures
    if known is not None:
        with temporary(spark) as keep:
            state = _state(versions, signatures, threshold)
            state_at = keep(store(state, "state"))
            state = read(state_at, state)
            remaining = _uncovered(signatures, state)
            left_at = keep(store(remaining, "left"))
            remaining = read(left_at, remaining)
    added_schema = T.StructType([*schema.fields, T.StructField("at", T.LongType()), T.StructField("catches", T.BooleanType())])
    new = None
    while not remaining.isEmpty():
        with temporary(spark) as keep:
            catching = spark.createDataFrame([], "n_tokens int") if state is None else state.where("catches").select("n_tokens").distinct()
            # ``ends`` and ``cuts`` have a row per word count at most.
            ends = settle(_next_batch(remaining, catching, batch_rows, batch_words, stride))
            batch = remaining.join(F.broadcast(ends), "n_tokens").where("sig_id < upto")
            batch = batch.withColumn("need", _need(threshold)).withColumn("cluster", F.col("sig_id") + base)
            parts = _grouped(state, batch, order)
            replayed = parts.groupBy("n_tokens", "part").applyInArrow(_replay(order, to_arrow_schema(added_schema)), added_schema)
            round_at = store(replayed, "added")
            added = read(round_at, replayed)
            # What comes after the first catch-all of one part of several waits.
            cuts = added.where("catches").groupBy("n_tokens").agg(F.min("at").alias("cut")).collect()
            if cuts:
                cuts = F.broadcast(spark.createDataFrame(cuts, "n_tokens int, cut long"))
                added = added.join(cuts, "n_tokens", "left").where("cut IS NULL OR at <= cut")
                round_at = store(added.select(*added_schema.fieldNames()), "added")
                ends = ends.join(cuts, "n_tokens", "left").withColumn("upto", F.least("upto", F.col("cut") - base + 1)).drop("cut")
            added_at.append(keep(round_at))
            new = spark.read.schema(added_schema).parquet(*added_at).select(*schema.fieldNames())
            versions = new if known is None else known.versions.unionByName(new)
            left = remaining.join(F.broadcast(ends), "n_tokens").where("sig_id >= upto").drop("upto")
            done, used = left.isEmpty(), [path for path in (left_at, state_at) if path]
            if not done:
                # Word counts of which nothing is left need no look-up any more.
                state = _state(versions, left, threshold)
                state_at = keep(store(state, "state"))
                state = read(state_at, state)
                remaining = _uncovered(left, state)
                left_at = keep(store(remaining, "left"))
                remaining = read(left_at, remaining)
        for path in used:
            drop_dir(spark, path)
        if done:
            break
    else:
        for path in (left_at, state_at):
            if path:
                drop_dir(spark, path)
    new = spark.createDataFrame([], schema) if new is None else new
    born = new.where(F.col("version") == 0)
    first, clusters = 0, None
    if known is not None:
        clusters = known.clusters
        first = clusters.agg(F.coalesce(F.max("template_id"), F.lit(0)).alias("m")).first().m
    # Without the words: the order needs none of them.
    ranked = rank_by_order(born.select("n_tokens", "cluster", *order), order, "template_id", first).select("n_tokens", "cluster", "template_id")
    clusters = ranked if clusters is None else clusters.unionByName(ranked)
    return MinedTemplates(versions, clusters, signatures, order, new, ranked)


def assign_templates(logs: DataFrame, mined: MinedTemplates, same_logs: bool = False) -> DataFrame:
    """Give each row the earliest template that covers it at its place in the order.

    ``same_logs`` says that ``logs`` are the ones just mined, whose distinct
    messages are at hand.
    """
    order = mined.order
    rows = with_signature(logs)
    spark = logs.sparkSession
    with temporary(spark) as keep:
        if same_logs:
            signatures = mined.signatures
        else:
            signatures = _distinct_signatures(rows.select("signature", *order), order)
        numbered = mined.numbered().select("n_tokens", "tokens", "template_id", F.struct(*order).alias("since"))
        pairs = match_templates(signatures.select("sig_id", "n_tokens", "tokens"), numbered)
        per_template = pairs.groupBy("sig_id", "template_id").agg(F.min("since").alias("since"))
        # Of a later and a higher template, neither can ever be the earliest.
        sooner = W.partitionBy("sig_id").orderBy("since", "template_id").rowsBetween(W.unboundedPreceding, -1)
        lower = F.min("template_id").over(sooner)
        steps = per_template.withColumn("lower", lower).where("lower is null or template_id < lower")
        steps = steps.groupBy("sig_id").agg(F.sort_array(F.collect_list(F.struct("since", "template_id"))).alias("steps"))
        table = signatures.join(steps, "sig_id").select(F.array_join("tokens", " ").alias("signature"), "steps")
        table_at = keep(store(table, "assignments"))
    table = spark.read.schema(table.schema).parquet(table_at)
    reached = F.filter("steps", lambda s: s["since"] <= F.struct(*order))
    chosen = F.when(F.size("steps") == 1, F.get(F.col("steps"), F.lit(0))).otherwise(F.element_at(reached, -1))
    joined = rows.join(broadcast_if_small(table), "signature")
    return joined.withColumn("template_id", chosen["template_id"]).drop("steps")


# --- template tables --------------------------------------------------------------


def template_text(rows: DataFrame, key: str = "template_id") -> DataFrame:
    """Template of each group of equally long token lists; unlike words become wildcards."""
    distinct = rows.select(key, "tokens").distinct()
    words = distinct.select(key, F.posexplode("tokens").alias("pos", "token")).distinct()
    per_position = words.groupBy(key, "pos").agg(F.count("*").alias("n"), F.any_value("token").alias("token"))
    word = F.when(F.col("n") > 1, fv.WILDCARD).otherwise(F.col("token"))
    listed = per_position.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", word.alias("word")))).alias("w"))
    return listed.select(key, F.array_join(F.col("w")["word"], " ").alias("template"))


def first_rows(rows: DataFrame, key: str, n: int = 5, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps that many per task and group."""
    first = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def template_params(rows: DataFrame, templates: DataFrame, key: str = "template_id", n: int = 5) -> DataFrame:
    """The words at the wildcards of the first ``n`` rows of each template that has any.

    ``rows`` need tokens, ``templates`` (key, template).
    """
    wild = templates.where(F.contains("template", F.lit(fv.WILDCARD)))
    wild = wild.select(key, F.split("template", " ").alias("_template"))
    first = first_rows(rows.select(key, "tokens", *ORDER).join(wild, key, "left_semi"), key, n)
    return first.join(wild, key).select(key, "rank", tf.parameters(F.col("tokens"), F.col("_template")).alias("params"))


def sample_params(assigned: DataFrame, mined: MinedTemplates, n: int = 5) -> DataFrame:
    """As :func:`template_params`, with each template as it was at the row's place.

    A row that started a template, or came before its first wildcard, has none.
    """
    order = mined.order
    numbered = mined.numbered().where(F.exists("tokens", lambda t: t == fv.WILDCARD))
    at = F.struct(F.struct(*order).alias("since"), F.col("tokens").alias("tokens"))
    history = numbered.groupBy("template_id").agg(
        F.sort_array(F.collect_list(at)).alias("history"), F.min(F.struct(*order)).alias("from")
    )
    history = settle(history)
    since = broadcast_if_small(history.select("template_id", "from"))
    late = assigned.select("template_id", "signature", *order).join(since, "template_id")
    late = first_rows(late.where(F.struct(*order) >= F.col("from")), "template_id", n, order)
    now = F.element_at(F.filter("history", lambda h: h["since"] <= F.struct(*order)), -1)
    params = tf.parameters(tf.tokens_of(F.col("signature")), now["tokens"])
    return late.join(broadcast_if_small(history.drop("from")), "template_id").select(
        "template_id", "rank", params.alias("params")
    )




def template_summary(
    assigned: DataFrame,
    templates: DataFrame,
    key: str = "template_id",
    samples: int = 5,
    logs: DataFrame | None = None,
) -> DataFrame:
    """Size, errors, first and last time, and first messages of each template.

    ``templates`` has (key, template). Times are the first and last in row
    order among rows with one. ``logs`` may name the table that ``assigned``
    was made from, to read the few messages shown from there.
    """
    text = text_or_null(timestamp_text(F.col("ts"), F.col("ts_raw")))
    rows = assigned.select(key, "level", "ts", "ts_raw", text.alias("time"), *ORDER)
    texts = (assigned if logs is None else logs).select("message", text.alias("time"), *ORDER)
    dated = F.when(F.col("time").isNotNull(), F.col("line_number"))
    per_source = rows.groupBy(key, "source").agg(
        F.count("*").alias("size"),
        F.count_if(is_error(F.col("level"))).alias("error_count"),
        F.min(dated).alias("first_line"),
        F.max(dated).alias("last_line"),
    )
    edge = lambda pick, line: pick(
        F.when(F.col(line).isNotNull(), F.struct("source", F.col(line).alias("line_number")))
    )
    totals = per_source.groupBy(key).agg(
        F.sum("size").alias("size"),
        F.sum("error_count").alias("error_count"),
        edge(F.min, "first_line").alias("first_at"),
        edge(F.max, "last_line").alias("last_at"),
    )
    totals = settle(totals)
    # Texts are fetched for the few rows wanted: places first, then their values.
    places = first_rows(rows.select(key, *ORDER), key, samples).select(key, "rank", F.struct(*ORDER).alias("place"))
    wanted = (
        places.withColumn("what", F.lit("sample"))
        .unionByName(totals.select(key, F.lit(0).alias("rank"), F.col("first_at").alias("place"), F.lit("first").alias("what")))
        .unionByName(totals.select(key, F.lit(0).alias("rank"), F.col("last_at").alias("place"), F.lit("last").alias("what")))
        .where(F.col("place").isNotNull())
    )
    wanted = settle(wanted.select(key, "rank", "what", "place.*"))
    texts = texts.join(broadcast_if_small(wanted), list(ORDER))
    is_sample = F.col("what") == "sample"
    texts = texts.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(is_sample, F.struct("rank", "message")))).alias("s"),
        F.max(F.when(F.col("what") == "first", F.col("time"))).alias("first_seen"),
        F.max(F.when(F.col("what") == "last", F.col("time"))).alias("last_seen"),
    )
    out = totals.join(texts, key).join(templates.select(key, "template"), key)
    return out.select(
        key, "template", "size", "error_count", "first_seen", "last_seen", F.col("s")["message"].alias("samples")
    ).orderBy(F.desc("size"), key)
