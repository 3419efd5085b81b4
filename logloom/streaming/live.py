"""Live parsing, metrics, alerts, templates and multi-line rows.

The stateless parts are the batch functions on a streaming DataFrame. What
needs earlier data is either a watermarked aggregation, or a micro-batch step
with a small table in a shared folder. Such a step writes one folder per
batch and overwrites it when Spark runs the batch again, so every row counts
once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from logloom import fixed_values as fv
from logloom.functions import normalize as nz
from logloom.operators import anomalies as an
from logloom.operators import templates as tm
from logloom.operators.metrics import count_levels, error_rate
from logloom.operators.parse import BY_LINE, group_multiline, parse_folded
from logloom.schema import LOG_SCHEMA, ORDER
from logloom.sources.text import number_batch, number_lines, number_whole, splits_of
from logloom.sources.workspace import broadcast_if_small, settle

Step = Callable[[DataFrame, int], None]


def stream_parse(lines: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parse arriving lines with a parse job. Lines without numbers give rows
    without numbers and ids; :func:`numbered` gives both."""
    if "line_number" not in lines.columns:
        lines = lines.withColumn("line_number", F.lit(None).cast("bigint"))
    return parse(lines.select(*ORDER, "line"))


@dataclass(frozen=True)
class _Numbered:
    """A step that numbers and parses the lines of a batch for another step."""

    parse: Callable[[DataFrame], DataFrame]
    step: Step

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.step(self.parse(number_batch(batch)), batch_id)

    def ahead(self, stream: DataFrame) -> tuple[DataFrame, Step]:
        """The same as a stream that is numbered and parsed on its way, so that
        it is analysed once and not per batch, and the step for its batches.
        One with a cut file is read again, numbered and parsed by itself."""

        def run(batch: DataFrame, batch_id: int) -> None:
            splits = splits_of(batch)
            if splits is None:
                raise RuntimeError("the files of a micro-batch are not known")
            if any(start for _, start in splits):
                batch = self.parse(number_lines(stream.read_again(sorted({path for path, _ in splits}))))
            self.step(batch, batch_id)

        return self.parse(number_whole(stream)), run


def numbered(parse: Callable[[DataFrame], DataFrame], step: Step) -> Step:
    """Number the lines of each micro-batch of :func:`read_log_stream`, parse
    them, and hand the rows to ``step``. A file arrives whole in one batch, so
    numbers and ids are those of the batch job."""
    return _Numbered(parse, step)


def watermarked(logs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return logs.withWatermark("ts", delay)


def stream_level_counts(logs: DataFrame) -> DataFrame:
    """Running rows per level (complete or update mode)."""
    return logs.groupBy("level").agg(F.count("*").alias("n"))


def stream_error_rate(logs: DataFrame) -> DataFrame:
    """Running rows, errors and error rate (complete mode)."""
    return error_rate(logs)


def stream_histogram(logs: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows per level in tumbling windows, each final once the watermark passes it."""
    window = F.window("ts", width)
    counts = watermarked(logs, delay).groupBy(window).agg(*count_levels())
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *counts.columns[1:])


def stream_auth_failures(
    logs: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Failed logins per source in sliding windows.

    All other rows share one group without a source. A filter before the
    aggregation would be run ahead of the watermark, which then would only
    move with failed logins.
    """
    window, source = F.window("ts", width, slide), F.when(an.tells_auth_failure(), an.auth_origin())
    counts = watermarked(logs, delay).groupBy(window, source.alias("auth_source"))
    counts = counts.agg(F.count(source).alias("n")).where("n > 0")
    return counts.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "auth_source", "n"
    )


_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
_PLAIN_FILES = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def run_step(stream: DataFrame, step: Step, checkpoint: str) -> DataStreamWriter:
    """A writer that runs ``step`` on each micro-batch.

    On a local disk, sets the session's checkpoint files to be renamed by the
    file system, unless the session has chosen a way: the default starts
    several processes for each of the three files of a micro-batch there.
    """
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file" and not spark.conf.get(_MANAGER, None):
        spark.conf.set(_MANAGER, _PLAIN_FILES)
    if isinstance(step, _Numbered) and step.parse in BY_LINE and hasattr(stream, "read_again"):
        stream, step = step.ahead(stream)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


# --- tables of one folder per batch -----------------------------------------------


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers of the folders below ``path``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def _last(spark: SparkSession, path: str, before: int = 2**62) -> str | None:
    """The newest finished folder of an earlier batch; a repeated batch does
    not see its first try. A folder holds all that its batch left to know, so
    one is enough."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for b in reversed([b for b in _folders(spark, path) if b < before]):
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={b}/_SUCCESS")
        if mark.getFileSystem(conf).exists(mark):
            return f"{path}/batch={b}"
    return None


def _read(spark: SparkSession, folder: str | None, schema) -> DataFrame | None:
    return spark.read.schema(schema).parquet(folder) if folder else None


# Batches after which what they added is gathered in one folder.
GATHER = 64


def _added(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """All rows that batches before ``before`` added below ``path``.

    Every batch writes what it adds, so a batch costs what it adds. Each
    ``GATHER`` batches the rows of all are gathered under ``all``, so a reader
    opens that folder and at most ``GATHER`` others, whose names follow from
    their numbers: nothing is listed. Micro-batches are numbered without gaps.
    """
    base = max(0, before - 1) // GATHER * GATHER
    folders = [f"{path}/all/batch={base}"] if base else []
    folders += [f"{path}/new/batch={b}" for b in range(base, before)]
    return spark.read.parquet(*folders) if folders else None


def _add(df: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch's rows; running the batch again replaces them."""
    if batch_id and batch_id % GATHER == 0:
        _put(_added(df.sparkSession, path, batch_id), f"{path}/all", batch_id)
    _put(df, f"{path}/new", batch_id)


def _next(spark: SparkSession, path: str) -> int:
    """The number after that of the newest finished batch."""
    last = _last(spark, f"{path}/new")
    return int(last.rpartition("=")[2]) + 1 if last else 0


def keep_rows(path: str) -> Step:
    """Keep the rows of each batch in a folder of its own."""

    def step(batch: DataFrame, batch_id: int) -> None:
        _put(batch, path, batch_id)

    return step


# --- live tail --------------------------------------------------------------------


def keep_newest(path: str, n: int = 50) -> Step:
    """Keep the newest ``n`` rows in the last folder below ``path``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        held = _read(batch.sparkSession, _last(batch.sparkSession, path, batch_id), batch.schema)
        rows = batch if held is None else batch.unionByName(held)
        newest = rows.orderBy(F.desc_nulls_last("ts"), *[F.desc(c) for c in ORDER]).limit(n)
        _put(newest, path, batch_id)

    return step


def last_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_last(spark, path))


# --- live error bursts --------------------------------------------------------------

_BUCKETS = "bucket bigint, total bigint, errors bigint"


def watch_bursts(counts: str, alerts: str, width_seconds: int = 3600) -> Step:
    """Add up errors per time bucket, then judge all buckets after each batch.

    ``counts`` gets the sums of each batch (rows per bucket, not logs);
    ``alerts`` the bursts known so far.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.where(F.col("ts").isNotNull())
        bucket = F.floor(F.unix_seconds("ts") / width_seconds).alias("bucket")
        errors = F.count_if(F.col("level").isin(fv.ERROR_LEVELS)).alias("errors")
        _add(dated.groupBy(bucket).agg(F.count("*").alias("total"), errors), counts, batch_id)
        sums = [F.sum(c).alias(c) for c in ("total", "errors")]
        start = F.timestamp_seconds(F.col("bucket") * width_seconds).alias("start_ts")
        buckets = _added(spark, counts, batch_id + 1).groupBy("bucket").agg(*sums)
        _put(an.error_bursts(dated, buckets.select("*", start)), alerts, batch_id)

    return step


# --- live templates -------------------------------------------------------------------

STREAM_ORDER = ("batch_id", *ORDER)


def _known(spark: SparkSession, path: str, before: int) -> tm.MinedTemplates | None:
    versions, clusters = (_added(spark, f"{path}/{name}", before) for name in ("versions", "clusters"))
    return None if versions is None else tm.MinedTemplates(versions.drop("batch"), clusters.drop("batch"), order=STREAM_ORDER)


def keep_templates(path: str, threshold: float = 0.5) -> Step:
    """Give arriving rows template numbers, as one run over all rows would.

    Below ``path``: versions and clusters hold what each batch added to the
    templates, rows the numbered logs of each batch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = settle(batch.withColumn("batch_id", F.lit(batch_id)))
        known = _known(spark, path, batch_id)
        mined = tm.mine_templates(batch, threshold, known, STREAM_ORDER)
        _put(tm.assign_templates(batch, mined, same_logs=True), f"{path}/rows", batch_id)
        _add(mined.new_clusters, f"{path}/clusters", batch_id)
        _add(mined.new_versions, f"{path}/versions", batch_id)

    return step


def stored_templates(spark: SparkSession, path: str) -> tm.MinedTemplates:
    return _known(spark, path, _next(spark, f"{path}/versions"))


# --- live multi-line rows ---------------------------------------------------------------

_LINES = "source string, line_number bigint, line string"
_OPEN = f"{_LINES}, since bigint"


def keep_multiline(
    path: str, number: bool = False, header_regex: str = fv.SPRING_HEADER_PATTERN, idle_batches: int | None = None, **options
) -> Step:
    """Fold stack traces that arrive over several micro-batches.

    With ``number``, the stream is one of files (:func:`read_log_stream`): a
    file is whole in its batch, so all its entries are done and nothing is
    held. Else the last entry of each source may go on, so its lines are held
    in ``open`` until a later header of that source closes it, until its
    source has had no lines for ``idle_batches`` batches, or until
    :func:`flush_multiline`. Closed entries go to ``rows``. Folding is the
    batch job, so a busy source is many tasks here as well.
    """

    def fold(lines: DataFrame) -> DataFrame:
        return group_multiline(lines, header_regex, **options).select(*LOG_SCHEMA.fieldNames())

    def whole_files(batch: DataFrame, batch_id: int) -> None:
        _put(fold(number_batch(batch)), f"{path}/rows", batch_id)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lines = batch.select(*ORDER, "line", F.lit(batch_id).cast("bigint").alias("since"))
        held = _read(spark, _last(spark, f"{path}/open", batch_id), _OPEN)
        lines = settle(lines if held is None else lines.unionByName(held))
        header = F.when(nz.strip(F.col("line")).rlike(header_regex), F.col("line_number"))
        last = lines.groupBy("source").agg(F.max(header).alias("last_header"), F.max("since").alias("last_seen"))
        if idle_batches is not None:
            done = F.lit(batch_id) - F.col("last_seen") >= idle_batches
            last = last.withColumn("last_header", F.when(~done, F.col("last_header")))
        last = settle(last)
        is_open = F.col("last_header").isNotNull() & (F.col("line_number") >= F.col("last_header"))
        parted = lines.join(broadcast_if_small(last), "source")
        _put(fold(parted.where(~is_open).select(*ORDER, "line")), f"{path}/rows", batch_id)
        _put(parted.where(is_open).select(*ORDER, "line", F.col("last_seen").alias("since")), f"{path}/open", batch_id)

    return whole_files if number else step


def flush_multiline(spark: SparkSession, path: str, **options) -> DataFrame:
    """The entries that are still open."""
    return group_multiline(spark.read.schema(_OPEN).parquet(_last(spark, f"{path}/open")).drop("since"), **options)


def multiline_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(*[f"{path}/rows/batch={b}" for b in _folders(spark, f"{path}/rows")])


_ENTRY = "source string, line_number bigint, line string, _lines array<string>"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _OpenEntries(StatefulProcessor):
    """Per source the lines of its last entry, in the state store, until a
    header follows or no line has come for ``idle_ms``."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "line_number bigint, line string")

    def handleInputRows(self, key, rows, timerValues):
        fresh = pd.concat(list(rows)).sort_values("line_number")
        entry = [(n, text) for n, text in self.open.get()] if self.open.exists() else []
        closed = []
        for number, line, is_header in zip(fresh["line_number"].tolist(), fresh["line"].tolist(), fresh["is_header"].tolist()):
            if is_header or not entry:
                closed.append(entry)
                entry = [(number, line)]
            else:
                entry.append((number, line))
            if not is_header and len(entry) == 1:  # no header yet: a row of its own
                closed.append(entry)
                entry = []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if entry:
            self.open.put(entry)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.open.clear()
        yield self._entries(key[0], closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        entry = [(n, text) for n, text in self.open.get()] if self.open.exists() else []
        self.open.clear()
        yield self._entries(key[0], [entry])

    def _entries(self, source: str, entries: list) -> pd.DataFrame:
        rows = [(source, e[0][0], e[0][1], [text for _, text in e[1:]]) for e in entries if e]
        return pd.DataFrame(rows, columns=["source", "line_number", "line", "_lines"])

    def close(self) -> None:
        pass


def stream_multiline(lines: DataFrame, header_regex: str = fv.SPRING_HEADER_PATTERN, idle_seconds: float = 300) -> DataFrame:
    """Fold stack traces of a stream of (source, line_number, line), as a
    stream of Spring Boot rows.

    The last entry of each source is kept in the state store, so a batch costs
    what it brings, and is given out when a header of its source follows or no
    line of it has come for ``idle_seconds``. Lines of a source come in order,
    over batches too; those that follow an entry given out for idleness are
    rows of their own. Sources are spread over tasks; one source is one task,
    so give a busy one a source per file.

    Sets the session's state store to RocksDB, which such state needs, unless
    the session has chosen one.
    """
    spark = lines.sparkSession
    if spark.conf.get(_STATE_STORE).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_STATE_STORE, _ROCKSDB)
    body = nz.strip(F.col("line"))
    rows = lines.where(body != "").select(*ORDER, "line", body.rlike(header_regex).alias("is_header"))
    folded = rows.groupBy("source").transformWithStateInPandas(_OpenEntries(int(idle_seconds * 1000)), _ENTRY, "Append", "ProcessingTime")
    return parse_folded(folded)
