import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import line_dedup as ld
from logloom.llm import minhash_dedup as md
from logloom.llm import suffix_dedup as sd
from logloom.llm.components import components
from logloom.llm.cuckoo import CuckooFilter
from logloom.llm.suffix_array import permuted_prefixes, suffix_array
from logloom.llm.vector_dedup import near_duplicate_vectors

LAST = float("inf")


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def kept_lines(rows):
    """Row by row: (id, lines, dropped, text); a null id comes last."""
    held = collections.defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 10:
                held[line_key(line)].add(LAST if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        mine = LAST if doc is None else doc
        keep = [x for x in lines if len(held.get(line_key(x), ())) < 2 or min(held[line_key(x)]) == mine]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def by_text(rows):
    return sorted(rows, key=str)


def test_lines(docs, corpus):
    got = ld.dedup_lines(docs, counts=True)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()]
    want = kept_lines(corpus)
    assert by_text(got) == by_text(want) and any(r[2] for r in want)


def test_lines_of_nothing(nothing):
    assert ld.dedup_lines(nothing).collect() == []


def test_lines_with_many_shards(docs, corpus, monkeypatch):
    monkeypatch.setattr(ld, "TASK_REFS", 20)
    index = ld.LineIndex.build(docs, shard_keys=50)
    got = ld.without_lines(docs, index.drops(), counts=True).collect()
    assert by_text((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == by_text(kept_lines(corpus))


def test_line_index_is_reversible(spark, unique_docs, unique):
    some, more = unique_docs.where("doc_id % 2 = 0"), unique_docs.where("doc_id % 2 = 1")
    first = ld.LineIndex.build(some)
    both = first.insert(more)
    back = both.delete(more.select("doc_id"))
    whole = ld.LineIndex.build(unique_docs)
    assert sorted(both.counts.collect()) == sorted(whole.counts.collect())
    assert sorted(back.counts.collect()) == sorted(first.counts.collect())
    assert sorted(both.drops().collect()) == sorted(whole.drops().collect())
    assert sorted(back.drops().collect()) == sorted(first.drops().collect())
    again = both.insert(more)
    assert sorted(again.counts.collect()) == sorted(whole.counts.collect())


def stored_bytes(spark, paths, name):
    rows = [spark.read.format("binaryFile").load(f"{p}/{name}").agg({"length": "sum"}).first()[0] or 0 for p in paths]
    return sum(rows)


def test_line_index_writes_what_changed(spark):
    """One document in a hundred more or less writes about that much."""
    say = lambda i: "\n".join(f"line number {i * 13 + k} of the corpus" for k in range(20)) + f"\nshared line of group {i % 40}"
    docs = spark.createDataFrame([(i, say(i)) for i in range(3000)], "doc_id long, text string")
    most, few = docs.where("doc_id % 100 > 0"), docs.where("doc_id % 100 = 0")
    first = ld.LineIndex.build(most)
    both = first.insert(few)
    back = both.delete(few.select("doc_id"))
    for name, changed in (("refs", both.paths[1:]), ("counts", both.paths[1:]), ("counts", back.paths[2:])):
        assert stored_bytes(spark, changed, name) < 0.1 * stored_bytes(spark, first.paths, name)
    whole = ld.LineIndex.build(docs)
    assert sorted(both.counts.collect()) == sorted(whole.counts.collect()) and sorted(both.drops().collect()) == sorted(whole.drops().collect())
    assert sorted(back.counts.collect()) == sorted(first.counts.collect()) and sorted(back.drops().collect()) == sorted(first.drops().collect())
    one = back.compacted()
    assert len(one.paths) == 1 and sorted(one.counts.collect()) == sorted(first.counts.collect()) and sorted(one.refs.collect()) == sorted(first.refs.collect())


def test_line_filters_grow_with_their_keys(spark):
    """Thirty times the keys: filters are built anew, nothing is stashed."""
    some = lambda a, b: spark.createDataFrame([(d, "\n".join(f"a line of number {k}" for k in range(i, i + 50))) for i in range(a, b, 50) for d in (2 * i, 2 * i + 1)], "doc_id long, text string")
    index = ld.LineIndex.build(some(0, 1000), shard_keys=400)
    small = sum(len(r.table) for r in index.filters.collect())
    for a in (1000, 11_000, 21_000):
        index = index.insert(some(a, a + 10_000))
    filters = index.filters.collect()
    assert all(not r.stash for r in filters) and sum(r.held for r in filters) == 31_000
    assert sum(len(r.table) for r in filters) > 10 * small
    back = index.delete(spark.range(2000, 62_000).selectExpr("id AS doc_id"))
    assert sum(r.held for r in back.filters.collect()) == 1000
    assert sorted(back.drops().collect()) == sorted(ld.LineIndex.build(some(0, 1000)).drops().collect())


def test_many_rows_without_an_id(spark):
    rows = [(None, f"shared line number {i % 7}\nown line of row {i}") for i in range(200)] + [(5, "SHARED line number 3 \nshared line number 9"), (6, "shared line number 9")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")
    got = ld.dedup_lines(docs, counts=True)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert by_text((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == by_text(kept_lines([(*r, None) for r in rows]))


def test_deleting_many_keys_at_once():
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 60_000)
    made = CuckooFilter(1000)
    made.insert(keys[:5000])  # far too many: most are in the stash
    made.delete(keys[:4000])
    assert made.contains(keys[4000:5000]).all() and (made.table > 0).sum() + len(made.stash) == 1000
    made = CuckooFilter(len(keys))
    made.insert(np.concatenate([keys, keys[:10], keys[:10]]))
    made.delete(np.concatenate([keys[5000:], keys[:10]]))
    assert made.contains(keys[:5000]).all() and (made.table > 0).sum() == 5010


@pytest.mark.parametrize("n", [0, 1, 7, 500, 20_000])
def test_cuckoo_filter(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
    made = CuckooFilter(n)
    made.insert(keys)
    assert made.contains(keys).all()
    made = CuckooFilter(table=made.to_bytes(), stash=made.stash.tolist())
    made.delete(keys[: n // 2])
    assert made.contains(keys[n // 2 :]).all() and made.contains(keys[: n // 2]).mean() < 0.01 if n > 1 else True
    others = np.random.default_rng(99).integers(-(2**63), 2**63 - 1, 20_000)
    assert made.contains(others).mean() < 0.001


def test_cuckoo_filter_too_small():
    keys = np.arange(1000)
    made = CuckooFilter(100)
    made.insert(keys)
    assert len(made.stash) and made.contains(keys).all()


def word_set(text, width):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if width else frozenset()


def classes(nodes, links):
    to = {n: n for n in nodes}

    def find(n):
        while to[n] != n:
            n = to[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        to[b] = a
    return {n: find(n) for n in nodes}


def near_groups(rows, width, percent):
    sets = collections.defaultdict(set)
    for doc, text, *_ in rows:
        if doc is not None and word_set(text, width):
            sets[doc].add(word_set(text, width))
    items = [(d, s) for d, group in sets.items() for s in group]
    links = [(a, b) for i, (a, s) in enumerate(items) for b, t in items[:i] if 100 * len(s & t) >= percent * len(s | t)]
    return classes({r[0] for r in rows if r[0] is not None}, links)


@pytest.mark.parametrize("width", [2, 5])
def test_near_documents(docs, corpus, width):
    want = near_groups(corpus, width, 80)
    got = md.near_duplicates(docs, width, 80).collect()
    assert len(got) == len(corpus) and any(k != v for k, v in want.items())
    sizes = collections.Counter((r[0], len(word_set(r[1], width))) for r in corpus)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    assert all(r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)


def test_near_documents_that_only_chains_link(spark, monkeypatch):
    """Texts that drift: neighbours are linked, the ends far apart."""
    monkeypatch.setattr(md, "BLOCK", 4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(60)] + [(100 + i, " ".join(words[200 + 11 * i : 260 + 11 * i])) for i in range(12)]
    got = {r.doc_id: r.component_id for r in md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == near_groups(rows, 2, 80)


def test_near_documents_kept(docs, corpus, nothing):
    got = md.without_near_duplicates(docs, 2, 80)
    assert got.columns == docs.columns
    want = near_groups(corpus, 2, 80)
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(r[0] for r in corpus if want.get(r[0]) == r[0])
    assert md.near_duplicates(nothing).collect() == []


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    for n in (1, 3, 40, 3000):
        items = np.unique(r.integers(0, 2**63, n, np.uint64))
        assert (md.sketch(items) == md.sketch(items)).all()
    a = np.unique(r.integers(0, 2**63, 4000, np.uint64))
    assert abs((md.sketch(a[:3000]) == md.sketch(a[1000:])).mean() - 0.5) < 0.2


def test_components(spark):
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)]
    want = classes({x for pair in links for x in pair}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: c for n, c in want.items() if any(a != b and n in (a, b) for a, b in links)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_suffix_arrays():
    r = np.random.default_rng(0)
    for trial in range(400):
        text = r.integers(0, int(r.integers(1, 6)), int(r.integers(0, 60))).astype(np.uint8)
        if trial % 3 == 0:
            text = np.concatenate([text, text, text[: len(text) // 2]])
        raw = text.tobytes()
        order = suffix_array(text)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert order.tolist() == want
        common = permuted_prefixes(text, order)
        for x, y in zip(want, want[1:]):
            n = 0
            while max(x, y) + n < len(raw) and raw[x + n] == raw[y + n]:
                n += 1
            assert common[y] == n


def cut_texts(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r[0], len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length, part, shard", [(40, 256, 1 << 19), (25, 4, 2000)])
def test_substrings(docs, corpus, nothing, monkeypatch, length, part, shard):
    monkeypatch.setattr(sd, "PART_CONTENTS", part)
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    small = [r for r in corpus if len(r[1] or "") < 20_000]
    got = sd.without_repeats(docs.where("text IS NULL OR length(text) < 20000"), length)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert by_text(map(tuple, got)) == by_text(cut_texts(small, length))
    assert sd.without_repeats(nothing).collect() == []


def test_substrings_within_long_texts():
    text = b"abcdefgh" * 300 + bytes(range(97, 123)) * 40
    for n, chunk in ((1, text), (2, text[:900])):
        first, last, names, twice = sd.named_segments(chunk, 400)
        assert first[0] == 0 and last[-1] == len(chunk) - 400 and (first[1:] == last[:-1] + 1).all() and twice.any(), n


def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 20))
    rows = [(i, (base[i % 12] + r.normal(size=20) * r.choice([0.02, 0.25, 1.5])).tolist()) for i in range(260)]
    rows += [(300 + i, rows[5][1]) for i in range(9)] + [(400, None), (401, []), (402, [0.0] * 20), (403, [float("nan")] * 20), (404, [None] * 20), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (None, rows[0][1]), rows[7], rows[7]]
    usable = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] / (np.linalg.norm(usable[a]) * np.linalg.norm(usable[b])) >= 0.95]
    degree = collections.Counter(x for pair in links for x in pair)
    group = classes({i for i, _ in rows if i is not None}, links)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = near_duplicate_vectors(frame, block=16).collect()
    assert len(got) == len(rows) and len(links) > 500
    for x in got:
        assert (x.n_links, x.component_id, x.kept) == ((0, None, True) if x.vec_id is None else (degree[x.vec_id], group[x.vec_id], group[x.vec_id] == x.vec_id))
    assert near_duplicate_vectors(frame.limit(0)).collect() == []


def test_vectors_of_unlike_length_do_not_meet(spark):
    """A vector, its near copy, and its copy one component shorter, which fills as much of the padded width."""
    r = np.random.default_rng(6)
    base = r.normal(size=(30, 64))
    base[:, 63] *= 1e-3  # the cut copies keep their direction
    rows = [(3 * i, v.tolist()) for i, v in enumerate(base)] + [(3 * i + 1, v[:63].tolist()) for i, v in enumerate(base)] + [(3 * i + 2, (v * 1.5 + 1e-4).tolist()) for i, v in enumerate(base)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (0, i) if i % 3 == 1 else (1, i - i % 3) for i in range(90)}


def test_vectors_planted_at_the_threshold(spark):
    """Pairs of cosine 0.950 to 0.960 with 64, 96 and 3 components: none is lost."""
    r = np.random.default_rng(8)
    rows = []
    for dim, n in ((64, 1200), (96, 1200), (3, 1)):
        a, b = r.normal(size=(2, n, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        cosine = r.uniform(0.9500001, 0.96, (n, 1))
        for one, two in zip(a, cosine * a + np.sqrt(1 - cosine**2) * b):
            rows += [(len(rows), one.tolist()), (len(rows) + 1, two.tolist())]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    lost = [x.vec_id for x in got if (x.n_links, x.component_id) != (1, x.vec_id - x.vec_id % 2)]
    assert len(got) == len(rows) and lost == []


def test_members_of_the_largest_label_do_not_meet(spark):
    from logloom.llm.meetings import each_meeting, strangers_in_blocks

    r = np.random.default_rng(8)
    rows = [(1, n, 0 if n < 400 else 1 + n % 5) for n in range(430)] + [(2, n, n % 3) for n in range(100)] + [(3, n, int(r.integers(0, 9))) for n in range(12)]
    placed = strangers_in_blocks(spark.createDataFrame(rows, "key long, node long, component long"), "key", "component", 16).toPandas()
    seen = collections.Counter()
    for _, group in placed.groupby("meeting"):
        for key, part, mask in each_meeting(group, "key"):
            nodes, label = part["node"].to_numpy(), part["component"].to_numpy()
            seen.update((key, *sorted((nodes[a], nodes[b]))) for a, b in zip(*np.nonzero(mask & (label[:, None] != label[None, :]))))
            assert len(part) <= 80
    want = {(k, a, b) for k, a, x in rows for j, b, y in rows if k == j and a < b and x != y}
    assert set(seen) == want and set(seen.values()) == {1}
    assert (placed["key"] == 1).sum() <= 400 * 2 + 30 * 29
