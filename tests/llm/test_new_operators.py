"""Alignment, Merkle manifest and decontamination against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logloom.llm import alignment, decontaminate, merkle
from logloom.llm.word_tokens import byte_letters, tokenizer_path

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(got, want):
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(want)


# --- alignment -------------------------------------------------------------------


class Plain:
    """Whole texts through the libraries, groups by a walk over byte ends."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
        self.byte = {c: i for i, c in enumerate(byte_letters())}

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        y = []
        for i in b:
            piece = self.b.id_to_piece(i)
            y.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        whole = (" " + text).encode()
        if b"".join(x) != whole or b"".join(y) != whole:
            return []
        out, i, j = [], 0, 0
        while i < len(a):
            ga, gb = [a[i]], [b[j]]
            p, q, i, j = len(x[i]), len(y[j]), i + 1, j + 1
            while p != q:
                if p < q:
                    ga.append(a[i])
                    p, i = p + len(x[i]), i + 1
                else:
                    gb.append(b[j])
                    q, j = q + len(y[j]), j + 1
            out.append((ga, gb))
        return out


def plain_alignment(rows):
    plain = Plain()
    groups = [plain.groups(text) for _, text in rows]
    links = [[(a, b) for ga, gb in g for a in ga for b in gb] for g in groups]
    count = Counter(p for x in links for p in set(x))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for (doc_id, _), g, x in zip(rows, groups, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        yield (
            doc_id, sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), len(x), sum(count[p] == best[p[0]] for p in x),
            sum(count[p] for p in x), sha(text) if g else "",
        )


ODD = [
    "", " ", "  two  spaces  ", "tab\t and\n newline \n\n x", "<|endoftext|> <s> </s> <0x0A> x", "a▁b c", "▁", "naïve café—東京 😀😀  x y ​z", "a" * 3000, "😀" * 200,
    "don't we'll  I'm 12345 6.7e-8", "\u0085 x \x1c y", "end ", " start", "\x00nul in it", "é combining", "ab " * 500, "x\r\ny  \r\n  z",
]


def test_alignment(spark, docs, corpus, nothing):
    got = alignment.cross_aligned(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(got.collect(), plain_alignment([(r[0], r[1]) for r in corpus]))
    assert alignment.cross_aligned(nothing).collect() == []


@pytest.mark.parametrize(("together", "most", "batch"), [(2, 5, 64), (3, 1 << 20, 1000), (4096, 1 << 20, 4 << 20)])
def test_alignment_of_odd_texts(spark, monkeypatch, together, most, batch):
    monkeypatch.setattr(alignment, "TOGETHER", together)
    monkeypatch.setattr(alignment, "MOST_LINKS", most)
    known = alignment.aligner(alignment.BYTE_BPE, alignment.PIECE_BPE)
    plain = Plain()
    for part in [ODD, *([t] for t in ODD)]:
        got = alignment.Batch(part, known)
        for text, measures in zip(part, got.measures):
            g = plain.groups(text)
            want = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(len(a) * len(b) for a, b in g))
            assert measures[:4] == want, text
    monkeypatch.setattr(alignment, "BATCH_BYTES", batch)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "end "), (3, ODD[3]), (99, None)]
    same(alignment.cross_aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_alignment(rows))


def test_alignment_of_a_hot_text(spark):
    rows = [(i, "one text of many copies" if i % 3 else f"text number {i} of its own") for i in range(3000)]
    same(alignment.cross_aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect(), plain_alignment(rows))


# --- Merkle manifest -------------------------------------------------------------


def plain_tree(rows, fanout=8):
    """Rows (doc_id, source, lang, n_chars, text) to the contract's columns."""

    def leaf(r, text):
        values = [*r[:4], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def build(hashes):
        """Levels of one tree, and a walk giving (left, right) per level."""
        levels = [hashes]
        while len(levels[-1]) > 1:
            h = levels[-1]
            levels.append([sha("".join(h[i : i + fanout])) for i in range(0, len(h), fanout)])
        return levels

    def way(levels, i):
        out = []
        for h in levels[:-1]:
            a = i // fanout * fanout
            out.append(("".join(h[a:i]), "".join(h[i + 1 : a + fanout])))
            i //= fanout
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r, r[4])))
        trees[g] = build([leaf(r, r[4]) for r in groups[g]])
    upper = build([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = way(trees[g], i) + way(upper, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, r[4].translate(LOWER) if hit and r[4] is not None else r[4])
            for left, right in path:
                node = sha(left + node + right)
            root = upper[-1][0]
            yield r[0], trees[g][0][i], trees[g][-1][0], root, sha("".join(a + b for a, b in path)), node, node == root


def manifest_of(spark, rows, fanout=8, parts=4):
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place string").repartition(parts)
    return merkle.verified(merkle.manifest(df, fanout=fanout)).collect()


@pytest.mark.parametrize(("n", "langs", "fanout"), [(1, 1, 8), (8, 1, 8), (9, 1, 8), (65, 2, 8), (700, 11, 8), (130, 100, 8), (50, 3, 2)])
def test_manifest(spark, n, langs, fanout):
    rows = [(i * 7 % 1001, f"s{i % 3}" if i % 5 else None, f"l{i * i % langs}" if i % 4 else None, i if i % 6 else None, ["Some Text é", "lower", None, ""][i % 4]) for i in range(n)]
    got = manifest_of(spark, rows, fanout)
    same(got, plain_tree(rows, fanout))
    assert n < 50 or {r.verified for r in got} == {True, False}


def test_manifest_of_odd_rows(spark, docs, corpus, nothing):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in corpus]
    same(merkle.verified(merkle.manifest(docs)).collect(), plain_tree(rows))
    assert merkle.verified(merkle.manifest(nothing)).collect() == []
    # one group with nearly all rows, rows without ids, rows repeated as they are
    hot = [(None if i % 3 == 0 else i // 2, None, "hot", 1, f"T{i // 2}") for i in range(600)] + [(1, None, "Z", 2, "x" * 100_000), (2, None, "é", 2, "y")]
    same(manifest_of(spark, hot, parts=9), plain_tree(hot))


def test_places_hold_across_partitions(spark):
    df = spark.range(1000).selectExpr("pmod(id * 37, 1000) AS v")
    got = merkle.numbered(df.repartition(13), [df["v"]], "numbered").collect()
    assert all(r.v == r.place for r in got) and len(got) == 1000


# --- decontamination -------------------------------------------------------------


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_hits(docs, items, window):
    grams = defaultdict(set)
    lists = [words(t) for _, t in items]
    for (item, _), w in zip(items, lists):
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[i : i + window])].add(item)
    for doc_id, text in docs:
        w, hit, found, longest = words(text), set(), set(), 0
        for g, owners in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found |= owners - {None}
                    for other in lists:
                        for k in range(len(other) - len(g) + 1):
                            n = 0
                            while i + n < len(w) and k + n < len(other) and w[i + n] == other[k + n]:
                                n += 1
                            longest = max(longest, n) if n >= len(g) else longest
        yield doc_id, len(w), len(hit), sorted(hit), sorted(map(str, found)), longest


ITEMS = [
    (1, "The quick brown Fox jumps over the lazy dog near the river bank today"), (2, "short item"), (3, "Ünïcode wörds ünd 42 things; more-than TEN words are in this one here"),
    (4, None), (5, "..."), (6, "a a a a a a a a a a a a a"), (7, "over the lazy dog near the river bank today and then some more words follow"),
    (None, "an item that has no id but more than ten words in a row"), (2, "other text of the same id with over ten words in it"), (8, "fox jumps over the lazy dog near the river bank"),
]
TEXTS = [
    "nothing to see", "see: the QUICK brown fox, jumps over the lazy dog near the river bank today! and then some more words follow", None, "", "short item short ITEM", "short",
    "ünïcode wörds ünd 42 things more than ten words are in this", "ÜNÏCODE wörds ünd 42 things more than ten words are", "a " * 9, "a " * 40 + "b " + "a " * 10,
    "an item that has no id but more than ten words in a row " * 3, "the quick brown fox jumps over the lazy dog\nnear the river bank of the quick brown fox jumps over", "x " * 30_000 + "other text of the same id with over ten words in it" + " y" * 10,
]


def found_of(spark, docs, items, window=10):
    table = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, n_words string, hits int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return table, bench, [(r.doc_id, r.n_words, r.n_hit, [k for a, b in zip(r.hits[::2], r.hits[1::2]) for k in range(a, b)], r["items"], r.longest) for r in decontaminate.contamination(table, bench, window).collect()]


@pytest.mark.parametrize("block", [1_000_000, 12])
@pytest.mark.parametrize("window", [10, 3])
def test_contamination(spark, monkeypatch, window, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs = [*enumerate(TEXTS), (None, TEXTS[1]), (1, TEXTS[1])]
    table, bench, got = found_of(spark, docs, ITEMS, window)
    same(got, plain_hits(docs, ITEMS, window))
    clean = decontaminate.decontaminated(table, bench, window)
    assert clean.columns == table.columns
    same([(r.doc_id, r.text) for r in clean.collect()], [(d, t) for (d, t), r in zip(docs, plain_hits(docs, ITEMS, window)) if not r[2]])


def test_contamination_at_random(spark):
    r = np.random.default_rng(4)
    say = lambda n: " ".join(r.choice(list("abc"), n))
    items = [(i, say(int(r.integers(1, 30)))) for i in range(40)]
    docs = [(i, say(int(r.integers(0, 120)))) for i in range(80)]
    for window in (4, 7):
        same(found_of(spark, docs, items, window)[2], plain_hits(docs, items, window))


def test_long_items_are_cut_with_an_overlap(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 15)
    item = " ".join(f"w{i}" for i in range(100))
    docs = [(i, " ".join(f"w{k}" for k in range(i, i + 10))) for i in range(0, 95)]
    got = found_of(spark, docs, [(7, item)])[2]
    assert [r[2] for r in sorted(got)] == [10 if i <= 90 else 0 for i in range(95)]


def test_contamination_without_rows(spark, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nothing, empty).collect() == []
    assert [r.n_hit for r in decontaminate.contamination(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), empty).collect()] == [0]
    assert decontaminate.contamination(nothing, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_new_queries_equal_their_sql(spark):
    import duckdb

    from logloom.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("op12_merkle_manifest", "op13_decontamination"):
        result = duck.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        same(QUERIES[name](spark, folder).select(*columns).collect(), result.fetchall())
