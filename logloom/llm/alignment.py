"""Which tokens of two tokenizers cover the same text, and how often.

Tokens of A (byte-level BPE over a space and the text) and of B (sentence-piece
BPE over the text, which adds that space) are cut into groups at the byte
offsets where tokens of both end. An A and a B token of one group are linked.
An id pair counts the documents that hold it linked.

1. Texts are brought together whole; each distinct text is tokenised and
   aligned once, with its number of documents as weight.
2. A batch of texts of some ``BATCH_BYTES`` keeps one list of its distinct
   pairs with summed weights; a text refers to that list. Pair counts are sums
   over these lists, so a common pair is one row per batch, not per text.
3. Counts go back to the batches that asked, are summed up per text there, and
   the measures of each text are joined to its documents by its digest.

Both tokenizers treat the text between single spaces alone: A starts a token
at a space between two other characters, B has no piece with a space after
another letter. So a batch aligns each distinct stretch of text between such spaces
once.

Rules: texts that are null or empty, or whose joined token bytes of A or B are
not the space and the text, have no tokens: zeros and an empty digest.
Documents without an id and repeated rows give a row each and count each. An
empty input gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.frames import as_bytes, batched, blocks, doc_table, stored
from logloom.llm.word_tokens import byte_letters, tokenizer_path

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bytes of text of a batch.
BATCH_BYTES = 4 << 20
# Stretches that are aligned as one text, the longest of them, and their most links.
TOGETHER = 4096
SHORT = 64
MOST_LINKS = 1 << 20
NONE = np.zeros(0, np.int64)
SPACE = "▁"
# A space beside white space (or at an end) is not a cut.
BESIDE = re.compile(r"\s | \s|^ | $")
CUT = re.compile(r"(?<=\S) (?=\S)")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def stretches(text: str) -> list[str]:
    """The text cut at its single spaces, each of which belongs to what
    follows it; the first stretch has the space that is added."""
    return CUT.split(text) if BESIDE.search(text) else text.split(" ")


def groups_of(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """(first A, end A, first B, end B) of each group, from token lengths in bytes."""
    out, i, j, n = [], 0, 0, len(a)
    while i < n:
        k, m = i, j
        ahead = a[i] - b[j]  # bytes that A's tokens of the group reach further
        i, j = i + 1, j + 1
        while ahead:
            if ahead < 0:
                ahead, i = ahead + a[i], i + 1
            else:
                ahead, j = ahead - b[j], j + 1
        out.append((k, i, m, j))
    return out


class Aligned:
    """Distinct stretches of text aligned. Per stretch ``held`` (whether the
    tokens' bytes are the text), ``sums`` (A tokens, B tokens, groups, links),
    ``texts`` (its groups, with a ``;`` after each), and the ``sizes`` links
    from ``starts`` on in ``codes``, as A << 32 | B; ``many`` has the distinct
    links and their numbers of stretches that were aligned alone."""

    def __init__(self, n: int) -> None:
        self.held, self.sums, self.texts = np.zeros(n, bool), np.zeros((n, 4), np.int64), [""] * n
        self.starts, self.sizes, self.codes, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64), [NONE], 0
        self.many: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def put(self, at: np.ndarray, sums: np.ndarray, texts: list[str], sizes: np.ndarray, codes: np.ndarray) -> None:
        self.held[at], self.sums[at], self.sizes[at] = True, sums, sizes
        self.starts[at] = self.end + np.cumsum(sizes) - sizes
        for i, text in zip(at.tolist(), texts):
            self.texts[i] = text
        self.codes.append(codes)
        self.end += len(codes)


class Aligner:
    """Aligns stretches of text: short ones many at once, for token ends of
    their concatenation are those of the parts; others one by one."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        pieces = {i: b"".join(map(byte.__getitem__, piece)) if set(piece) <= set(byte) else piece.encode() for piece, i in self.a.get_vocab().items()}
        self.a_bytes = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, v)), np.int64) for v in (self.a_bytes, self.b_bytes))
        # each id as it stands before a comma and at the end of its side of a group
        self.shown = [f"{i}{mark}" for v, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(v))]

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(BYTE_PIECE.fullmatch(piece)[1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """A and B tokens of a space and each text."""
        ours = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [(x.ids, y) for x, y in zip(ours, self.b.encode(texts, num_threads=1))]

    def same(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = (" " + text).encode()
        return b"".join([self.a_bytes[i] for i in a]) == whole and b"".join([self.b_bytes[i] for i in b]) == whole

    def __call__(self, stretches: list[str]) -> Aligned:
        out = Aligned(len(stretches))
        short = np.array([0 < len(s) <= SHORT and not (s[0].isspace() or s[-1].isspace()) for s in stretches], bool)
        alone = np.flatnonzero(~short).tolist()
        at = np.flatnonzero(short)
        for i in range(0, len(at), TOGETHER):
            part = at[i : i + TOGETHER]
            if not self.together(out, part, [stretches[k] for k in part.tolist()]):
                alone += part.tolist()
        for i, (a, b) in zip(alone, self.encoded([stretches[k] for k in alone])):
            if stretches[i] and self.same(stretches[i], a, b):
                self.one(out, i, a, b)
        return out

    def together(self, out: Aligned, at: np.ndarray, stretches: list[str]) -> bool:
        text = " ".join(stretches)
        ((a, b),) = self.encoded([text])
        if not self.same(text, a, b):
            return False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last = np.cumsum([len(s.encode()) + 1 for s in stretches])
        owner = np.searchsorted(last, shared)  # stretch of each group
        ends = np.searchsorted(shared, last)
        if (shared[np.minimum(ends, len(shared) - 1)] != last).any():
            return False
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        n, m = np.bincount(a_group), np.bincount(b_group)
        links = n * m
        if links.sum() > MOST_LINKS:
            return False
        # A tokens of a group, then its B tokens
        both = np.empty(len(a) + len(b), np.int64)
        a_last, b_last = (np.concatenate([g[1:] != g[:-1], [True]]) for g in (a_group, b_group))
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        both[np.arange(len(a)) + (np.cumsum(m) - m)[a_group]] = a + a_last * n_a
        both[np.arange(len(b)) + np.cumsum(n)[b_group]] = 2 * n_a + b + b_last * n_b
        pieces = list(map(self.shown.__getitem__, both.tolist()))
        cuts = [0, *(np.cumsum(n + m)[ends]).tolist()]
        texts = ["".join(pieces[x:y]) for x, y in zip(cuts, cuts[1:])]
        group = np.repeat(np.arange(len(shared)), links)
        k = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        codes = a[(np.cumsum(n) - n)[group] + k // m[group]] << 32 | b[(np.cumsum(m) - m)[group] + k % m[group]]
        sums = np.stack([np.bincount(owner, v, len(at)) for v in (n, m, np.ones_like(n), links)], axis=1).astype(np.int64)
        out.put(at, sums, texts, sums[:, 3], codes)
        return True

    def one(self, out: Aligned, i: int, a: list[int], b: list[int]) -> None:
        text, pairs, n_links = [], {}, 0
        groups = groups_of(self.a_sizes[a].tolist(), self.b_sizes[b].tolist())
        for x, y, k, m in groups:
            text.append(",".join(map(str, a[x:y])) + "|" + ",".join(map(str, b[k:m])) + ";")
            n_links += (y - x) * (m - k)
            # within a group only distinct ids meet, with the product of their numbers
            there = Counter(b[k:m]).items()
            for p, n in Counter(a[x:y]).items():
                for q, o in there:
                    pairs[p << 32 | q] = pairs.get(p << 32 | q, 0) + n * o
        out.held[i], out.sums[i], out.texts[i] = True, (len(a), len(b), len(groups), n_links), "".join(text)
        out.many[i] = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


@lru_cache(1)
def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    return Aligner(*(p if os.path.isabs(p) else tokenizer_path(p) for p in (byte_bpe, piece_bpe)))


class Batch:
    """Texts aligned together: ``measures`` per text, and their pairs as
    places (``which`` text, ``place`` in ``pairs``, ``times``)."""

    def __init__(self, texts: list[str], align: Aligner) -> None:
        cut = [stretches(t) if t else [] for t in texts]
        number: dict[str, int] = {s: i for i, s in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        found = align(list(number))
        self.measures: list[tuple[int, int, int, int, str]] = []
        owners, parts = [NONE], [NONE]
        for i, c in enumerate(cut):
            at = np.fromiter(map(number.__getitem__, c), np.int64, len(c))
            if not len(at) or not found.held[at].all():
                self.measures.append((0, 0, 0, 0, ""))
                continue
            groups = "".join(map(found.texts.__getitem__, at.tolist()))[:-1]
            self.measures.append((*found.sums[at].sum(axis=0).tolist(), hashlib.sha256(groups.encode()).hexdigest()))
            owners.append(np.full(len(at), i, np.int64))
            parts.append(at)
        key, uses = summed(np.concatenate(owners) << 32 | np.concatenate(parts), np.ones(sum(map(len, parts)), np.int64))
        text, stretch = key >> 32, key & 0xFFFFFFFF
        n = found.sizes[stretch]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(found.starts[stretch], n)
        codes, which, times = [np.concatenate(found.codes)[each]], [np.repeat(text, n)], [np.repeat(uses, n)]
        for t, k, u in zip(text.tolist(), stretch.tolist(), uses.tolist()) if found.many else ():
            if k in found.many:
                pairs, o = found.many[k]
                codes.append(pairs)
                which.append(np.full(len(pairs), t))
                times.append(o * u)
        self.pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
        links, self.times = summed(np.concatenate(which) << 32 | place, np.concatenate(times))
        self.which, self.place = links >> 32, (links & 0xFFFFFFFF).astype(np.int32)


def text_key(text: Column) -> Column:
    """What a document and its text's measures are joined by."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


ALIGNED = "key binary, batch long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<int>, a array<int>, b array<int>, docs array<long>"


def aligned_texts(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """One row per distinct text. ``places`` and ``times`` are its pairs, as
    places in its batch's list, and their links. The first row of a batch has
    the list: ``a, b`` and the documents that hold each pair."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))

    def work(batch: pa.RecordBatch) -> dict:
        raw, weights = as_bytes(batch["text"]), batch["n"].to_numpy()
        out: dict[str, list] = {name.split()[0]: [] for name in ALIGNED.split(", ")}
        for a, b in blocks(raw, BATCH_BYTES):
            got = Batch([t.decode("utf-8") for t in raw[a:b]], aligner(byte_bpe, piece_bpe))
            n = b - a
            held = np.bincount(got.place, weights=weights[a:b][got.which], minlength=len(got.pairs)).astype(np.int64)
            used = np.flatnonzero(held)
            again = np.zeros(len(got.pairs), np.int32)
            again[used] = np.arange(len(used))
            cuts = np.searchsorted(got.which, np.arange(1, n))
            name = int.from_bytes(os.urandom(8)) >> 1
            rest = [None] * (n - 1)
            measures = [list(v) for v in zip(*got.measures)]
            rows = ([hashlib.sha256(t).digest() for t in raw[a:b]], [name] * n, *measures, np.split(again[got.place], cuts), np.split(got.times.astype(np.int32), cuts))
            lists = ([v, *rest] for v in ((got.pairs[used] >> 32).astype(np.int32), (got.pairs[used] & 0xFFFFFFFF).astype(np.int32), held[used]))
            for k, v in zip(out, (*rows, *lists)):
                out[k] += v
        return out

    return batched(texts, work, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n, best``: documents that hold a pair, and whether no pair of
    its A id has more."""
    lists = aligned.where("a IS NOT NULL").select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).select("p.*")
    counts = stored(lists.groupBy("a", "b").agg(F.sum("docs").alias("n")), "pair_counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def text_sums(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, n_best, count_sum`` of each text with links."""
    asked = aligned.where("a IS NOT NULL").select("batch", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("batch", "place", "p.*")
    told = asked.join(counts, ["a", "b"]).select("batch", "place", "n", "best")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        place = right["place"].to_numpy()
        n[place], best[place] = right["n"].to_numpy(), right["best"].combine_chunks().to_numpy(zero_copy_only=False)
        places, times = left["places"].combine_chunks(), left["times"].combine_chunks().flatten().to_numpy()
        sizes, at = np.diff(places.offsets.to_numpy()), places.flatten().to_numpy()
        upto = [np.concatenate([[0], np.cumsum(times * v[at])]) for v in (best, n)]
        ends = np.cumsum(sizes)
        sums = [v[ends] - v[ends - sizes] for v in upto]
        return pa.table({"key": left["key"], "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])})

    texts = aligned.where("n_links > 0").select("key", F.col("batch").alias("home"), "places", "times")
    return texts.groupBy("home").cogroup(told.groupBy("batch")).applyInArrow(work, "key binary, n_best long, count_sum long")


def cross_aligned(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``, one row per document."""
    rows = doc_table(docs)
    aligned = stored(aligned_texts(rows, byte_bpe, piece_bpe), "aligned")
    sums = text_sums(aligned, pair_counts(aligned))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    measures = aligned.select("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "key", "left")
    keyed = rows.select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("key"))
    return keyed.join(measures, "key").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
