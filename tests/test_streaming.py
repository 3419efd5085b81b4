"""Streams give what the batch jobs give on the same files."""

import time

import pytest
from pyspark.sql import functions as F

from checks.live import _in_parts as in_parts
from logloom.operators import parse as P
from logloom.operators import templates as tm
from logloom.plans.overview import ingest
from logloom.sources import text
from logloom.sources.text import number_lines, read_log_lines, read_log_stream
from logloom.streaming import live
from logloom.sources.workspace import new_dir, settle
from tests.test_templates import greedy, random_rows


def play(stream, step, name):
    spark = stream.sparkSession
    q = live.run_step(stream, step, new_dir(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()


def line_stream(spark, files):
    """A stream that gets one file per micro-batch, and the same lines as a table."""
    path = new_dir(spark, "in")
    for name, text in files.items():
        spark.createDataFrame([(t,) for t in text], "v string").coalesce(1).write.mode("append").text(f"{path}/{name}")
    glob = f"{path}/*"
    return read_log_stream(spark, glob, max_files=1), read_log_lines(spark, glob)


def test_stream_parse_and_tail(spark):
    text = [f'{{"ts":"2024-01-01T00:00:{i:02d}Z","level":"warn","msg":"m {i}"}}' for i in range(40)]
    stream, lines = line_stream(spark, {"a": text[:25], "b": text[25:]})
    out = new_dir(spark, "tail")
    play(live.stream_parse(stream, P.parse_json), live.keep_newest(out, 7), "cp")
    got = [r.message for r in live.last_folder(spark, out).orderBy(F.desc("ts")).collect()]
    assert got == [f"m {i}" for i in range(39, 32, -1)]


def test_stream_multiline_equals_batch(spark):
    head = "2026-10-02 00:30:{:02d}.000 ERROR 1 --- [x] a.B : m{}"
    text = ["early"]
    for i in range(30):
        text += [head.format(i, i), *[f"\tat f{j}" for j in range(i % 4)]]
    rows = [("s", i, t) for i, t in enumerate(text, 1)]
    lines = spark.createDataFrame(rows, "source string, line_number long, line string")
    path, out = new_dir(spark, "lines"), new_dir(spark, "ml")
    for lo, hi in ((1, 20), (20, 22), (22, 23), (23, 200)):
        part = lines.where((F.col("line_number") >= lo) & (F.col("line_number") < hi))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(path)
    play(stream, live.keep_multiline(out), "cp")
    got = live.multiline_rows(spark, out).unionByName(live.flush_multiline(spark, out))
    want = P.group_multiline(lines)
    key = ["line_number", "level", "message", "raw", "id"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


@pytest.mark.parametrize("idle", [300, 0.001])
def test_multiline_in_the_state_store(spark, idle):
    text, rows = ["early", "too early"], []
    for i in range(24):
        text += [SPRING.format(i, i), *[f"\tat f{j}" for j in range(i % 4)], " "][: 2 + i % 5]
    rows += [("s", i, t) for i, t in enumerate(text, 1)]
    lines = spark.createDataFrame([*rows, ("a", 1, SPRING.format(1, 1)), ("a", 2, "\tat x"), ("n", 5, "no header")], "source string, line_number long, line string")
    path, out = new_dir(spark, "lines"), new_dir(spark, "ml")
    cuts = (1, 200) if idle < 1 else (1, 20, 22, 23, 200)
    for lo, hi in zip(cuts, cuts[1:]):
        lines.where((F.col("line_number") >= lo) & (F.col("line_number") < hi)).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("late", 1, SPRING.format(9, 9))], lines.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = live.stream_multiline(stream, idle_seconds=idle).writeStream.foreachBatch(live.keep_rows(out))
    # Timers keep such a query going, so it is stopped here once its folders are there.
    q = q.option("checkpointLocation", new_dir(spark, "cp")).trigger(processingTime="1 second").start()
    want_batches, end = len(cuts) + 3, time.time() + 90
    while time.time() < end and q.exception() is None and len(live._folders(spark, out)) < want_batches:
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None
    key = ["source", "line_number", "level", "message", "raw", "id"]
    got = sorted(map(tuple, spark.read.parquet(out).where("source <> 'late'").select(key).collect()))
    want = P.group_multiline(lines)
    held = {"s": max(i for i, t in enumerate(text, 1) if "ERROR" in t), "a": 1}
    if idle > 1:  # the last entry of each source is open yet
        want = want.where(" AND ".join(f"NOT (source = '{s}' AND line_number = {n})" for s, n in held.items()))
    assert got == sorted(map(tuple, want.select(key).collect())) and len(got) > 20


SPRING = "2026-10-02 00:30:{:02d}.000 ERROR 1 --- [x] a.B : m{}"


def test_files_need_no_flush(spark):
    """The last entry of a file that has arrived is no longer open."""
    files = {f"f{k}": [SPRING.format(1, k), "\tat a", SPRING.format(2, k), f"\tat b{k}", "\tat c"] for k in range(3)}
    stream, lines = line_stream(spark, files)
    out = new_dir(spark, "ml")
    play(stream, live.keep_multiline(out, number=True), "cp")
    key = ["source", "line_number", "message", "id"]
    got = sorted(map(tuple, live.multiline_rows(spark, out).select(key).collect()))
    assert len(got) == 6 and got == sorted(map(tuple, P.group_multiline(lines).select(key).collect()))


@pytest.mark.parametrize("idle", [None, 1])
def test_own_header_and_idle_sources(spark, idle):
    """An entry over two batches is one row; a silent source is closed."""
    parts = [[("a", 1, "BEGIN 1"), ("b", 1, "BEGIN 9"), ("b", 2, " y")], [("a", 2, " x"), ("a", 3, "BEGIN 2")], [("a", 4, " z")]]
    path, out = new_dir(spark, "lines"), new_dir(spark, "ml")
    schema = "source string, line_number bigint, line string"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    play(stream, live.keep_multiline(out, header_regex="^BEGIN", idle_batches=idle), "cp")
    got = {(r.source, r.line_number, r.raw) for r in live.multiline_rows(spark, out).collect()}
    closed = {("a", 1, "BEGIN 1\n x")} | ({("b", 1, "BEGIN 9\n y")} if idle else set())
    assert {(s, n) for s, n, _ in got} == {(s, n) for s, n, _ in closed}
    rest = {(r.source, r.line_number) for r in live.flush_multiline(spark, out, header_regex="^BEGIN").collect()}
    assert rest == {("a", 3)} | (set() if idle else {("b", 1)})


def test_stream_ids_are_those_of_the_batch_job(spark):
    text = [f'{{"level":"warn","msg":"m {i}"}}' for i in range(30)]
    stream, lines = line_stream(spark, {"a": text[:12], "b": text[12:]})
    out = new_dir(spark, "rows")
    play(stream, live.numbered(P.parse_json, live.keep_rows(out)), "cp")
    got, want = (sorted(map(tuple, df.select("id", "source", "line_number", "message").collect())) for df in (spark.read.parquet(out), P.parse_json(lines)))
    assert got == want and len({r[0] for r in got}) == 30
    assert P.parse_json(lines.withColumn("line_number", F.lit(None).cast("bigint"))).select("id").distinct().collect()[0].id is None


@pytest.mark.parametrize("split", [None, "300"])
def test_lines_of_a_batch_are_numbered_as_they_pass(spark, monkeypatch, split):
    """Nothing is stored for files that are whole; cut ones get their numbers as well."""
    path, out = new_dir(spark, "in"), new_dir(spark, "rows")
    for k in range(5):
        lines = [f"{k} {i} " + "x" * (i % 30) if i % 4 else "" for i in range(10 + 37 * k)]
        rows = [(bytearray(b"\xe9\xff") if i == 5 else bytearray(t.encode()),) for i, t in enumerate(lines)]
        spark.createDataFrame(rows, "v binary").coalesce(1).selectExpr("cast(v AS string) AS v").write.text(f"{path}/f{k}")
    key, arrow = "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = sorted(map(tuple, read_log_lines(spark, f"{path}/*").selectExpr("source", "line_number", "cast(line AS binary)").collect()))
    before, cut = spark.conf.get(key), []
    monkeypatch.setattr(text, "stored", lambda df, name, f=text.stored: cut.append(name) or f(df, name))
    spark.conf.set(arrow, "7")
    if split:
        spark.conf.set(key, split)
    try:
        stream = read_log_stream(spark, f"{path}/*", max_files=3)
        play(stream, live.numbered(lambda df: df, live.keep_rows(out)), "cp")
    finally:
        spark.conf.set(key, before)
        spark.conf.unset(arrow)
    got = sorted(map(tuple, spark.read.parquet(out).selectExpr("source", "line_number", "cast(line AS binary)").collect()))
    assert got == want and len(got) == 420
    assert bool(cut) == bool(split)


@pytest.mark.parametrize("split, planned", [(None, 1), ("300", 6)])
def test_lines_are_parsed_on_their_way(spark, monkeypatch, split, planned):
    """A stream is planned once, not per batch; batches with cut files by themselves."""
    path, out, text = new_dir(spark, "in"), new_dir(spark, "rows"), '{{"level":"warn","msg":"m {} {}"}}'
    for k in range(5):
        lines = [text.format(k, i) if i % 4 else "" for i in range(30)]
        spark.createDataFrame([(t,) for t in lines], "v string").coalesce(1).write.text(f"{path}/f[{k}]")
    key, calls = "spark.sql.files.maxPartitionBytes", []
    want = P.parse_json(read_log_lines(spark, f"{path}/*")).select("id", "source", "line_number", "message")
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(P, "_parse", lambda *args, f=P._parse: calls.append(1) or f(*args))
    before = spark.conf.get(key)
    if split:
        spark.conf.set(key, split)
    try:
        play(read_log_stream(spark, f"{path}/*", max_files=1), live.numbered(P.parse_json, live.keep_rows(out)), "cp")
    finally:
        spark.conf.set(key, before)
    got = sorted(map(tuple, spark.read.parquet(out).select("id", "source", "line_number", "message").collect()))
    assert got == want and len(got) == 110
    assert len(calls) == planned


def test_a_batch_writes_what_it_adds(spark, monkeypatch):
    text = [f'{{"ts":"2024-01-01T{i:02d}:00:00Z","level":"error","msg":"m {i}"}}' for i in range(20)]
    stream, _ = line_stream(spark, {f"f{k}": text[5 * k : 5 * k + 5] for k in range(4)})
    counts, alerts = new_dir(spark, "counts"), new_dir(spark, "alerts")
    monkeypatch.setattr(live, "GATHER", 2)
    play(live.stream_parse(stream, P.parse_json), live.watch_bursts(counts, alerts), "cp")
    assert [spark.read.parquet(f"{counts}/new/batch={b}").count() for b in range(4)] == [5] * 4
    assert live._added(spark, counts, 4).agg(F.sum("total")).first()[0] == 20
    assert spark.read.parquet(f"{counts}/all/batch=2").count() == 10
    # a batch that runs again replaces what it added
    live._add(spark.range(7).selectExpr("id AS bucket", "id AS total", "id AS errors"), counts, 3)
    assert live._added(spark, counts, 4).count() == 22 and live._next(spark, counts) == 4


@pytest.mark.parametrize("gather", [64, 2])
def test_stream_templates_equal_one_run(spark, monkeypatch, gather):
    monkeypatch.setattr(live, "GATHER", gather)
    data = random_rows(11, 240, 4, 5)
    ids, texts, _ = greedy(data)
    rows = [("z" if i < 100 else "a", i, " ".join(t), "INFO") for i, t in enumerate(data)]  # later files sort first
    df = spark.createDataFrame(rows, "source string, line_number long, message string, level string")
    path, out = new_dir(spark, "msgs"), new_dir(spark, "tpl")
    for lo, hi in ((0, 100), (100, 150), (150, 240)):
        df.where((F.col("line_number") >= lo) & (F.col("line_number") < hi)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    play(stream, live.keep_templates(out), "cp")
    got = {r.line_number: r.template_id for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == dict(enumerate(ids))
    assert {r.template_id: r.template for r in live.stored_templates(spark, out).latest().collect()} == dict(enumerate(texts, 1))
    # each batch wrote its own versions only, and the last one again writes the same
    added = [spark.read.parquet(f"{out}/versions/new/batch={b}") for b in range(3)]
    assert all({r.batch_id for r in df.select("batch_id").collect()} <= {b} for b, df in enumerate(added))
    before = sorted(map(str, added[2].collect()))
    live.keep_templates(out)(df.where("line_number >= 150"), 2)
    assert sorted(map(str, spark.read.parquet(f"{out}/versions/new/batch=2").collect())) == before
    assert {r.template_id: r.template for r in live.stored_templates(spark, out).latest().collect()} == dict(enumerate(texts, 1))


def test_stream_bursts(spark):
    text = []
    for hour in range(12):
        errors = 40 if hour == 7 else 1
        text += [f'{{"ts":"2024-01-01T{hour:02d}:00:{i:02d}Z","level":"{"error" if i < errors else "info"}","msg":"m"}}' for i in range(50)]
    stream, _ = line_stream(spark, {"a": text[:380], "b": text[380:]})
    counts, alerts = new_dir(spark, "counts"), new_dir(spark, "alerts")
    play(live.stream_parse(stream, P.parse_json), live.watch_bursts(counts, alerts), "cp")
    got = live.last_folder(spark, alerts).collect()
    assert [(r.start_ts.hour, r.errors, r.total, r.severity) for r in got] == [(7, 40, 50, "high")]


def test_line_numbers_of_split_files(spark):
    path = new_dir(spark, "big")
    text = [f"line {i} " + "x" * (i % 50) for i in range(1, 5001)]
    spark.createDataFrame([(t,) for t in text], "v string").coalesce(1).write.text(path)
    spark.createDataFrame([("",), ("b",), ("",), ("c",)], "v string").coalesce(1).write.mode("append").text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = read_log_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 8
        rows = settle(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    big = {r.line_number: r.line for r in rows if len(r.line) > 1}
    assert big == dict(enumerate(text, 1))
    assert sorted((r.line_number, r.line) for r in rows if len(r.line) <= 1) == [(1, ""), (2, "b"), (3, ""), (4, "c")]


@pytest.mark.parametrize("first, then", [("3000", "90000"), ("90000", "3000")])
def test_no_line_is_lost_when_files_are_cut_otherwise(spark, first, then):
    """The frame is made with one way of cutting files and read with another."""
    path = new_dir(spark, "cut")
    text = [f"line {i} " + "x" * (i % 50) for i in range(1, 5001)]
    spark.createDataFrame([(t,) for t in text], "v string").coalesce(1).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", first)
        lines = read_log_lines(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", then)
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.line_number: r.line for r in rows} == dict(enumerate(text, 1)) and len(rows) == 5000


def test_ingest_keeps_every_line(spark):
    path, out = new_dir(spark, "once"), new_dir(spark, "out")
    text = [f'{{"level":"warn","msg":"m {i}"}}' for i in range(200)]
    spark.createDataFrame([(t,) for t in text], "v string").coalesce(1).write.text(path)
    assert sorted(r.line_number for r in ingest(spark, path, out).collect()) == list(range(1, 201))


def test_text_may_vanish_once_it_is_read(spark):
    path = new_dir(spark, "gone")
    spark.createDataFrame([(f"x {i}",) for i in range(50)], "v string").coalesce(1).write.text(path)
    lines = read_log_lines(spark, path, decode=True)
    for f in spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:", "")).collect():
        open(f[0], "w").close()
    assert sorted(r.line_number for r in lines.collect()) == list(range(1, 51))


def test_parts_are_four_batches_of_many_files(spark):
    rows = spark.range(1, 1001).select(F.col("id").alias("line_number"))
    stream, out = in_parts(rows, file_rows=50).withColumn("file", F.input_file_name()), new_dir(spark, "rows")
    play(stream, live.keep_rows(out), "cp")
    for i in range(4):
        n, files, lo, hi = spark.read.parquet(f"{out}/batch={i}").agg(F.count("*"), F.count_distinct("file"), F.min("line_number"), F.max("line_number")).first()
        assert (n, files, lo, hi) == (250, 5, 250 * i + 1, 250 * (i + 1))
