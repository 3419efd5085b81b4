"""Template mining against a plain loop over all rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions import templates as tf
from logloom.operators import templates as tm
from logloom.sources.workspace import shared_dir

WILD = "<*>"


def greedy(token_lists, threshold=0.5):
    """Row by row: (template of each row, final templates, parameters per row)."""
    found, ids, params = [], [], []
    for tokens in token_lists:
        best, best_share = None, -1.0
        for i, known in enumerate(found):
            if len(known) != len(tokens):
                continue
            share = sum(a == b or a == WILD for a, b in zip(known, tokens)) / len(tokens) if tokens else 1.0
            if share > best_share:
                best, best_share = i, share
        if best is None or best_share < threshold:
            found.append(list(tokens))
            ids.append(len(found))
            params.append([])
        else:
            changed = [a != b for a, b in zip(found[best], tokens)]
            params.append([t for t, c in zip(tokens, changed) if c])
            found[best] = [WILD if c else a for a, c in zip(found[best], changed)]
            ids.append(best + 1)
    return ids, [" ".join(t) for t in found], params


def random_rows(seed, n, words=4, longest=5):
    rng = random.Random(seed)
    vocabulary = [chr(97 + i) for i in range(words)]
    return [[rng.choice(vocabulary) for _ in range(rng.randint(0, longest))] for _ in range(n)]


def as_logs(spark, token_lists, start=1):
    rows = [("s", i, " ".join(t), "ERROR" if i % 7 == 0 else "INFO") for i, t in enumerate(token_lists, start)]
    df = spark.createDataFrame(rows, "source string, line_number long, message string, level string")
    ts = F.when(F.col("line_number") % 3 != 0, F.timestamp_seconds("line_number"))
    return df.repartition(7).withColumn("ts", ts).withColumn("ts_raw", F.lit(None).cast("string"))


@pytest.mark.parametrize(
    "seed, n, words, longest, options",
    [
        (1, 400, 4, 5, {}),
        (2, 400, 3, 7, {"batch_rows": 9, "stride": 3}),  # many rounds
        (3, 2000, 12, 6, {"batch_rows": 60, "stride": 10}),
        (5, 1500, 26, 9, {"batch_words": 500, "stride": 20, "threshold": 0.6}),
        (4, 300, 4, 6, {"threshold": 0.7}),
    ],
)
def test_mining_equals_row_by_row(spark, seed, n, words, longest, options):
    data = random_rows(seed, n, words, longest)
    logs = as_logs(spark, data)
    ids, texts, params = greedy(data, options.get("threshold", 0.5))
    mined = tm.mine_templates(logs, **options)
    got = {r.template_id: r.template for r in mined.latest().collect()}
    assert got == {i: t for i, t in enumerate(texts, 1)}
    assigned = tm.assign_templates(logs, mined)
    rows = {r.line_number: r.template_id for r in assigned.collect()}
    assert rows == {i: t for i, t in enumerate(ids, 1)}
    if not options:
        shown = tm.sample_params(assigned, mined).orderBy("template_id", "rank").collect()
        want = {}
        for i, p in zip(ids, params):
            if p and len(want.setdefault(i, [])) < 5:
                want[i].append(p)
        have = {}
        for r in shown:
            have.setdefault(r.template_id, []).append(r.params)
        assert have == {k: v for k, v in want.items() if v}
        check_summary(tm.template_summary(assigned, mined.latest()).collect(), data, ids, texts)


def test_mining_in_many_shuffle_partitions(spark):
    """Known templates meet their messages where partitions are not brought together."""
    data = random_rows(6, 300, 12, 4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = tm.mine_templates(as_logs(spark, data), batch_rows=30, stride=5).latest().collect()
    finally:
        spark.conf.set(key, before)
    assert {r.template_id: r.template for r in got} == dict(enumerate(greedy(data)[1], 1))


def test_rows_compared_at_once_or_by_lists():
    rng = np.random.default_rng(3)
    for width, need in ((6, 3), (11, 7), (4, 1), (3, 0), (0, 0)):
        grids = [tm._Grid(width, need, 80, 0, indexed) for indexed in (False, True)]
        for row in (*range(80), 5, 17, 5):
            line = rng.integers(0, 5, width, dtype=np.int32)  # 0 is the wildcard
            for grid in grids:
                grid.put(row, line, 1)
        for line in rng.integers(0, 5, (50, width), dtype=np.int32):
            (rows, agree), (listed, same) = (grid.alike(line) for grid in grids)
            assert rows.tolist() == listed.tolist() and agree.tolist() == same.tolist()
    assert tm._many(16_000, 16_000) and not tm._many(1_000, 1_000)


def check_summary(rows, data, ids, texts):
    from datetime import datetime, timezone

    when = lambda i: datetime.fromtimestamp(i, timezone.utc).isoformat()
    assert [r.template_id for r in rows] == sorted(set(ids), key=lambda k: (-ids.count(k), k))
    for r in rows:
        mine = [i for i, k in enumerate(ids, 1) if k == r.template_id]
        dated = [i for i in mine if i % 3]
        assert r.size == len(mine) and r.error_count == sum(i % 7 == 0 for i in mine)
        assert r.template == texts[r.template_id - 1]
        assert r.first_seen == (when(dated[0]) if dated else None)
        assert r.last_seen == (when(dated[-1]) if dated else None)
        assert r.samples == [" ".join(data[i - 1]) for i in mine[:5]]


def test_known_templates_are_extended(spark):
    data = random_rows(9, 600, 4, 5)
    ids, texts, _ = greedy(data)
    first, second = as_logs(spark, data[:200]), as_logs(spark, data[200:], 201)
    mined = tm.mine_templates(second, known=tm.mine_templates(first))
    assert {r.template_id: r.template for r in mined.latest().collect()} == dict(enumerate(texts, 1))
    rows = {r.line_number: r.template_id for r in tm.assign_templates(second, mined).collect()}
    assert rows == {i: t for i, t in enumerate(ids, 1) if i > 200}


def test_two_transfers_share_a_template(spark):
    logs = as_logs(spark, [["Moved", "714", "files", "to", "node", "10.4.0.1"], ["Moved", "25", "files", "to", "node", "10.4.0.9"]])
    mined = tm.mine_templates(logs)
    r = tm.template_summary(tm.assign_templates(logs, mined), mined.latest()).collect()
    assert [(x.template, x.size) for x in r] == [("Moved <NUM> files to node <IP>", 2)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("id 123e4567-e89b-12d3-a456-426614174000 ok", "id <UUID> ok"),
        ("from 10.0.0.1 port 22", "from <IP> port <NUM>"),
        ("at 0xdeadBEEF", "at <HEX>"),
        ("sha deadbeefdeadbeef", "sha <HASH>"),
        ("call http://a.b/c?d=1 now", "call <URL> now"),
        ("GET /items/42 x", "GET <PATH><NUM> x"),
        ("  b123x\t7  ", "b123x\t<NUM>"),
        ("ä1 x2 33", "ä1 x2 <NUM>"),
        ("", ""),
    ],
)
def test_mask(spark, text, want):
    df = spark.createDataFrame([(text,)], "m string")
    assert df.select(tf.mask(F.col("m"))).first()[0] == want


def test_tokens_and_similarity(spark):
    df = spark.createDataFrame([(" a  b\tc ", ["a", "x", "<*>"]), ("", []), ("a", ["a", "b"])], "m string, t array<string>")
    tokens = tf.tokenize(F.col("m"))
    got = df.select(tokens, tf.similarity(tokens, F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c"], 2 / 3), ([], 1.0), (["a"], 0.0)]
    sig = df.select(tf.signature(F.col("m")).alias("s")).select(tf.tokens_of(F.col("s")), tf.n_tokens(F.col("s")))
    assert [tuple(r) for r in sig.collect()] == [(["a", "b", "c"], 3), ([], 0), (["a"], 1)]


def test_mining_of_the_events_table(spark):
    from checks import render as r

    logs = r.log_table(spark, "/root/testdata/sf0.01", message=r.NAMED_MESSAGE)
    logs = logs.withColumn("message", F.translate("message", "0123456789", "#" * 10))
    logs = logs.withColumn("message", F.translate("message", "/#.:", "xyzw"))  # nothing left to mask
    rows = logs.orderBy("line_number").select("line_number", "message").collect()
    ids, texts, _ = greedy([row.message.split() for row in rows])
    mined = tm.mine_templates(logs)
    assert {row.template_id: row.template for row in mined.latest().collect()} == dict(enumerate(texts, 1))
    got = {row.line_number: row.template_id for row in tm.assign_templates(logs, mined).collect()}
    assert got == {row.line_number: i for row, i in zip(rows, ids)}


@pytest.mark.parametrize("batch_rows", [10_000, 8])
def test_rounds_leave_nothing_but_their_templates(spark, batch_rows):
    rows = [("s", i, f"{chr(97 + i % 20)}q {chr(97 + i // 20)}w x{i:b}y") for i in range(120)]
    logs = spark.createDataFrame(rows, "source string, line_number long, message string")
    before = set(os.listdir(shared_dir(spark)))
    mined = tm.mine_templates(logs, batch_rows=batch_rows, stride=1)
    mined = tm.assign_templates(logs, mined, same_logs=True)
    left = set(os.listdir(shared_dir(spark))) - before
    names = [name for folder in left if folder.startswith("logloom-") for name in os.listdir(f"{shared_dir(spark)}/{folder}")]
    assert mined.count() == len(rows)
    assert set(names) == {"placed", "added", "assignments"} and names.count("placed") == 2
