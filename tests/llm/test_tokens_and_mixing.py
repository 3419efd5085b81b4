import collections
import re
import zlib
from array import array

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import mixing, packing, quality_model, quality_rules, token_counts, token_store, word_tokens
from logloom.llm.doc_stats import DocStats
from logloom.llm.frames import batched, new_dir, stored
from tests.llm.test_dedup import kept_lines, near_groups


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokens.tokenizer_path(word_tokens.WORD_BPE))


@pytest.fixture(scope="module")
def ids(plain):
    return lambda text: plain.encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(array("I", numbers).tobytes())


def test_words_are_encoded_as_the_library_does(ids):
    r = np.random.default_rng(0)
    parts = [*"aZÉŉſİΣς́ﬁ1KΩẞÅ_$ß.,'\" \n\t\x1c\x85\xa0漢😀ÿŽ½", "<|endoftext|>", "'s", "'ll", "!!", "don't"]
    texts = ["".join(r.choice(parts, r.integers(0, 40))) for _ in range(4000)]
    coder = word_tokens.WordEncoder(word_tokens.tokenizer_path(word_tokens.WORD_BPE), memory=500)
    for start in range(0, len(texts), 400):
        some = texts[start : start + 400]
        for text, raw in zip(some, coder.encode(pa.array(some))):
            assert np.frombuffer(raw, "<u4").tolist() == ids(text), text
    assert coder.encode(pa.array([None, "", " "])) == [b"", b"", b""] and coder.encode(pa.array([], pa.string())) == []


def test_token_store(spark, docs, corpus, nothing, ids):
    path = new_dir(spark, "tokens")
    token_store.write_tokens(docs, path)
    places = token_store.token_places(spark, path).collect()
    want = collections.Counter((r[0], len(ids(r[1])) + 1, crc([*ids(r[1]), 1])) for r in corpus)
    assert collections.Counter((p.doc_id, p.n_tokens, p.ids_crc32) for p in places) == want
    at = 0
    for p in sorted(places, key=lambda p: p.start):
        assert p.start == at
        at += p.n_tokens
    order = [p.doc_id for p in sorted(places, key=lambda p: p.start)]
    assert order == sorted(order, key=lambda d: (d is None, d))
    assert token_store.look_up(spark, path, [7]).collect()[0].ids == [*ids(corpus[7][1]), 1]
    assert "PushedFilters: [In(doc_id" in token_store.look_up(spark, path, [7, 9])._jdf.queryExecution().toString()
    empty = new_dir(spark, "tokens")
    token_store.write_tokens(nothing, empty)
    assert token_store.token_places(spark, empty).collect() == []


def test_places_follow_ids_where_part_numbers_gain_a_digit(spark, tmp_path):
    """100,000 files and more: part-100000 sorts before part-99999 by name."""
    from pyarrow import orc

    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])
    for part, ids in (("99998", [1, 2]), ("99999", [3, 4]), ("100000", [5]), ("100001", [6, None])):
        rows = [{"doc_id": d, "tie": 0, "n_tokens": 3, "ids": [7, 8, d or 0]} for d in ids]
        orc.write_table(pa.Table.from_pylist(rows, schema), str(tmp_path / f"part-{part}-x.orc"))
    places = sorted(token_store.token_places(spark, str(tmp_path)).collect(), key=lambda p: p.start)
    assert [(p.doc_id, p.start) for p in places] == [(1, 0), (2, 3), (3, 6), (4, 9), (5, 12), (6, 15), (None, 18)]


def test_store_has_bloom_filters_and_row_index(spark, docs):
    from pyarrow import orc

    path = new_dir(spark, "tokens")
    token_store.write_tokens(docs, path)
    names = [r.path for r in spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:", "").alias("path")).collect()]
    files = [orc.ORCFile(n) for n in names if n.endswith(".orc")]
    assert any(f.row_index_stride == token_store.INDEX_ROWS and f.nstripes for f in files)


@pytest.fixture(scope="module")
def pieces_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=word_tokens.tokenizer_path(token_counts.PIECE_BPE))


def test_prefix_tables(docs, corpus, pieces_model, nothing):
    got = token_counts.token_totals(docs, 50).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(pieces_model.encode(r[1] or "")), len(pieces_model.encode(r[1] or "")) > 50) for r in corpus)
    assert collections.Counter(map(tuple, got)) == want
    assert token_counts.token_totals(nothing, 50).collect() == []


def test_every_prefix_has_its_count(pieces_model):
    r = np.random.default_rng(1)
    parts = [*"the of andéß▁ \n\t.1漢😀", "  ", "tion", "ing", "internationalization"]
    counter = token_counts.SegmentCounter(word_tokens.tokenizer_path(token_counts.PIECE_BPE), memory=50)
    for _ in range(60):
        text = "".join(r.choice(parts, r.integers(0, 12)))
        counts = counter.prefix_counts([text.encode()])[0]
        exact = [len(pieces_model.encode(text[:k])) for k in range(len(text) + 1)]
        assert (counts[-1] if len(counts) else 0) == exact[-1]
        for budget in range(max(exact) + 2):
            best = max(k for k, n in enumerate(exact) if n <= budget)
            assert token_counts.longest_prefix(text, counts, budget) == text[:best], (text, budget)


@pytest.mark.parametrize("budget", [7, 50])
def test_longest_prefixes_of_a_stored_table(docs, corpus, nothing, pieces_model, budget):
    some = docs.where("text IS NULL OR length(text) < 20000")
    got = token_counts.budgeted(stored(token_counts.prefix_counts(some), "prefixes"), budget).collect()
    want = collections.Counter()
    for doc, text, *_ in (r for r in corpus if len(r[1] or "") < 20_000):
        n, text = len(pieces_model.encode(text or "")), text or ""
        cut = text if n <= budget else text[: max(k for k in range(min(len(text), 40 * budget)) if len(pieces_model.encode(text[:k])) <= budget)]
        want[(doc, len(text.encode()), n, n > budget, len(cut.encode()))] += 1
    assert collections.Counter(map(tuple, got)) == want and any(r.over_limit for r in got)
    lean = stored(token_counts.prefix_counts(some, budget=budget), "prefixes")
    assert collections.Counter(map(tuple, token_counts.budgeted(lean, budget).collect())) == want
    assert lean.where("text IS NOT NULL").count() == sum(r.over_limit for r in got)
    assert token_counts.budgeted(token_counts.prefix_counts(nothing), budget).collect() == []


def test_prefix_of_a_text_without_spaces_walks_no_further_than_the_budget(pieces_model, monkeypatch):
    text, walked, inner = "internationalization" * 2000, [], token_counts.inner_counts
    monkeypatch.setattr(token_counts, "inner_counts", lambda segment, model: walked.append(len(segment)) or inner(segment, model))
    counts = token_counts.SegmentCounter(word_tokens.tokenizer_path(token_counts.PIECE_BPE)).prefix_counts([text.encode()])[0]
    best = max(k for k in range(400) if len(pieces_model.encode(text[:k])) <= 20)
    assert token_counts.longest_prefix(text, counts, 20) == text[:best]
    assert max(walked) <= 20 * token_counts.prefix_bpe(token_counts.PIECE_BPE).longest < len(text)


def test_token_query_answers_the_budget_on_whole_tables(spark, docs):
    from logloom.llm.queries import QUERIES

    folder = new_dir(spark, "tables")
    docs.where("length(text) > 20000").write.parquet(f"{folder}/documents.parquet")
    row = QUERIES["op5_token_counts"](spark, folder).collect()[0]
    assert row.over_limit and 0 < row.prefix_bytes < row.n_bytes


def test_truncation(docs, corpus, pieces_model):
    got = token_counts.truncated(token_counts.prefix_counts(docs), 20).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert len(pieces_model.encode(r.text or "")) <= 20


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(64.0, 64.0, 4096.0), (64.0, 3.0, 2000.0)])
def test_best_fit_keeps_every_capacity(score, capacity):
    lengths = np.random.default_rng(2).integers(1, 45, 900)
    number, offset = packing.best_fit(lengths, capacity, score=score)
    for n in np.unique(number):
        mine = lengths[number == n]
        assert mine.sum() <= capacity[0] and len(mine) <= capacity[1] and (mine**2).sum() <= capacity[2]
        order = np.argsort(offset[number == n])
        assert (offset[number == n][order] == np.concatenate([[0], np.cumsum(mine[order])[:-1]])).all()
    if score == "norm" and capacity[1] == 64:
        assert len(np.unique(number)) <= -(-lengths.sum() // 64) + 1


def check_packing(got, rows, ids, capacity):
    want = collections.Counter()
    for r in rows:
        all_ids = [*ids(r[1]), 0]
        for k in range(0, len(all_ids), capacity):
            part = all_ids[k : k + capacity]
            want[(r[0], k // capacity, k, len(part), crc(part))] += 1
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(docs, corpus, nothing, ids, monkeypatch):
    used = check_packing(packing.packed(docs, 256).collect(), corpus, ids, 256)
    assert used <= 1.02 * -(-sum(len(ids(r[1])) + 1 for r in corpus) // 256) + 1
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    check_packing(packing.packed(docs, 256).collect(), corpus, ids, 256)
    assert packing.packed(nothing).collect() == []


def test_rules(docs, corpus, nothing):
    got = quality_rules.verdicts(docs).collect()
    assert len(got) == len(corpus)
    kept = collections.Counter(r[0] for r in corpus if all(not rule.rejects(DocStats((r[1] or "").encode())) for rule in quality_rules.RULES))
    assert collections.Counter(r.doc_id for r in got if r.kept) == kept
    passing = quality_rules.passing(docs)
    assert passing.columns == docs.columns and collections.Counter(r.doc_id for r in passing.collect()) == kept
    assert quality_rules.verdicts(nothing).collect() == [] and quality_rules.passing(nothing).collect() == []


def test_repeated_windows_by_hand():
    for text, n in (("a b c a b c", 6), ("a b c d", 0), ("x x x x", 4), ("x x x", 0), ("a b c z a b c", 6), ("", 0)):
        assert DocStats(text.encode()).n_repeat_words == n, text


def test_cascade_orders_by_rejection_per_cost():
    rules = tuple(quality_rules.Rule(n, (n,), lambda d: False) for n in ("dear", "cheap", "useless"))
    rejected = np.array([[1, 1, 1, 0], [1, 1, 0, 0], [0, 0, 0, 0]], bool)
    order = quality_rules.ordered(rules, {"dear": 1.0, "cheap": 0.1, "useless": 0.01}, rejected)
    assert [r.name for r in order] == ["cheap", "dear", "useless"]


def test_classifier(spark, docs, corpus, nothing):
    labels = spark.createDataFrame([(i, int(len(corpus[i][1] or "") > 150)) for i in range(200)] + [(201, None), (None, 1)], "doc_id long, quality int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert np.mean([(r.score > 0.5) == (len(corpus[r.doc_id][1] or "") > 150) for r in held]) > 0.9
    assert quality_model.classify(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality_model.classify(nothing, labels).collect() == []


def test_flat_trees_score_as_trees():
    r = np.random.default_rng(0)
    rows = r.normal(size=(500, 4))
    forest = quality_model.train(rows, (rows[:, 0] * rows[:, 1] > 0).astype(float), trees=20, depth=3)
    for row, score in zip(rows[:50], forest.scores(rows[:50])):
        total = forest.base
        for feature, limit, value in zip(forest.feature, forest.limit, forest.value):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            total += value[node - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((forest.scores(rows) > 0.5) == (rows[:, 0] * rows[:, 1] > 0)).mean() > 0.9


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_level(sizes):
    """Share the budget by weight, cap, share again what is over."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] if s in over else level * weight[s] for s in (over or open_)}
        budget -= sum(2 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    return target


def test_mixing(docs, corpus, nothing, monkeypatch):
    got = mixing.mixed(docs).collect()
    sizes = collections.Counter()
    for r in corpus:
        sizes[r[3]] += n_words(r[1])
    target = water_level(sizes)
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((r[0], n_words(r[1])) for r in corpus)
    taken = collections.Counter()
    source = {r[0]: r[3] for r in corpus if r[0] is not None}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
    for s in ("s0", None):
        assert abs(taken[s] - target[s]) < 30_000
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(sizes.values()), rel=0.35)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs).collect()))
    rows = mixing.mixture(docs)
    assert rows.columns == docs.columns
    times = collections.Counter((r.doc_id, n_words(r.text)) for r in rows.collect() if n_words(r.text))
    want = collections.Counter()
    for r in got:
        if r.taken:
            want[(r.doc_id, r.size)] += r.taken // r.size
    assert times == want
    assert mixing.mixed(nothing).collect() == [] and mixing.mixture(nothing).collect() == []


def test_mixing_uses_no_python(docs):
    plan = mixing.mixture(docs)._jdf.queryExecution().toString() + mixing.mixed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, docs, corpus, nothing, ids):
    """Each stage against a plain version, on what the stage before kept."""
    frame, rows = docs, corpus
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, "")
        if name == "quality_rules":
            rows = [r for r in rows if all(not rule.rejects(DocStats((r[1] or "").encode())) for rule in quality_rules.RULES)]
        elif name == "line_dedup":
            rows = [(d, text, *r[2:]) for (d, _, _, text), r in zip(kept_lines(rows), rows)]
        elif name == "near_dedup":
            group = near_groups(rows, 5, 80)
            rows = [r for r in rows if group.get(r[0]) == r[0]]
        elif name == "source_mix":
            times = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mixed(frame).collect()}
            rows = [r for r in rows for _ in range(times[r[0]]) if n_words(r[1])]
        got = corpus_pipeline.stored(out, name)
        if name == "best_fit_packing":
            check_packing(got.collect(), [tuple(r) for r in frame.collect()], ids, 2048)
        else:
            assert got.columns == docs.columns
            have = collections.Counter((r.doc_id, r.text) for r in got.collect() if n_words(r.text))
            assert have == collections.Counter((r[0], r[1]) for r in rows if n_words(r[1])), name
            assert rows
        frame = got
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").collect() == []


def test_workers_drop_what_other_steps_kept(spark, docs):
    held = lambda batch: {"n": [word_tokens.encoder.cache_info().currsize] * batch.num_rows}
    packing.pieces(docs, 2048).collect()
    assert 1 in {r.n for r in batched(docs.select("doc_id"), held, "n int", uses=(word_tokens.encoder,)).collect()}
    assert {r.n for r in batched(docs.select("doc_id"), held, "n int").collect()} == {0}


def test_pipeline_steps_get_small_batches(spark, docs):
    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows for b in batches]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    corpus_pipeline.quality_rules(spark, docs, "")
    found = [r.n for r in spark.range(5000).coalesce(1).mapInArrow(sizes, "n long").collect()]
    spark.conf.unset(key)
    assert sum(found) == 5000 and max(found) <= corpus_pipeline.BATCH_ROWS


def test_queries_equal_their_sql(spark):
    from logloom.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(found.fetchall()) == sorted(map(tuple, queries.QUERIES[name](spark, folder).select(*columns).collect())), name


def test_token_query_gets_few_bytes_at_once(spark, docs):
    from logloom.llm.frames import BATCH_BYTES
    from logloom.llm.queries import QUERIES

    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows for b in batches]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    folder = new_dir(spark, "tables")
    docs.where("doc_id < 20").write.parquet(f"{folder}/documents.parquet")
    long = spark.range(2000).selectExpr("id", "repeat('x', 10000) AS text").coalesce(1)
    QUERIES["op5_token_counts"](spark, folder)
    found = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
    spark.conf.unset(key)
    assert sum(found) == 2000 and max(found) * 10_000 <= 1.1 * BATCH_BYTES


def test_prefix_lookup_drops_the_counter_of_the_table(spark, docs):
    held = lambda batch: {"n": [token_counts.segment_counter.cache_info().currsize] * batch.num_rows}
    some = docs.where("doc_id < 100").repartition(32)  # so that each worker has tasks
    token_counts.token_totals(some, 50).collect()
    assert 1 in {r.n for r in batched(some, held, "n int", uses=(token_counts.segment_counter,)).collect()}
    assert {r.n for r in batched(some, held, "n int", uses=(token_counts.prefix_bpe,)).collect()} == {0}
