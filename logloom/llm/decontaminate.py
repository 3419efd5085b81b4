"""Benchmark passages in training texts, by suffix arrays over the texts.

Words are runs of ASCII letters (lower-cased), digits and other non-ASCII
characters. Texts are sorted shard by shard: a shard is some ``SHARD_BYTES`` of
whole texts, its words are numbers, and its suffix array orders all suffixes
that begin with a word of the benchmark. Every suffix of every benchmark item
is searched for in every shard by bisection; the range of suffixes that share
its first ``window`` words are its places. The words that these windows cover
are hit. From each place, bisection among the benchmark's own sorted suffixes
gives the longest run of words that a text shares with an item.

No text is shuffled and no text is cut, so what a shard finds is all there is
about its documents. The benchmark is the query set: it goes to the shards in
blocks of some ``BLOCK_WORDS`` words, each a broadcast of that size, one
after the other over the same rows.

Rules: null text has no words and is clean; an item of fewer words than a
window is one window, an item without words is none; rows of one item id are
one item; items without an id hit words but are not listed; repeated documents
and documents without an id give a row each; an empty benchmark finds nothing,
no documents give no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.frames import as_bytes, batched, blocks, doc_table, give_back, stored

WINDOW = 10
SHARD_BYTES = 8 << 20
# Words of the benchmark in one broadcast, and in one piece of an item.
BLOCK_WORDS = 1_000_000
PIECE_WORDS = 50_000
# Blocks that are searched in a row before the rows are stored.
CHAIN = 4
KEY_BITS = 62
PLAIN = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())
FOUND = "n_words long, n_hit long, hits array<long>, items array<string>, longest long"


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row, and how many each text has."""
    lists = pc.ascii_split_whitespace(pa.array([t.translate(PLAIN) for t in texts], pa.large_binary()).cast(pa.large_string()))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), np.diff(upto[offsets - offsets[0]])


def item_pieces(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, words, n``: items as words with a space between, long ones as
    pieces that overlap by a window less one word."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"item": [], "words": [], "n": []}
        for item, text in zip(batch["item"].to_pylist(), as_bytes(batch["text"])):
            words = text.translate(PLAIN).decode().split(" ")
            words = [w for w in words if w]
            for a in range(0, max(1, len(words) - window + 1), PIECE_WORDS - window + 1):
                piece = words[a : a + PIECE_WORDS]
                if piece:
                    for k, v in zip(out, (item, " ".join(piece), len(piece))):
                        out[k].append(v)
        return out

    rows = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text"))
    return batched(rows, work, "item string, words string, n long").distinct()


def packed(codes: np.ndarray, bits: int, words: int) -> np.ndarray:
    """The first ``words`` numbers of each suffix in one integer."""
    padded = np.concatenate([codes, np.zeros(words, codes.dtype)]).astype(np.int64)
    key = np.zeros(len(codes), np.int64)
    for k in range(words):
        key = (key << bits) | padded[k : len(codes) + k]
    return key


def sorted_suffixes(codes: np.ndarray, key: np.ndarray, words: int, depth: int) -> np.ndarray:
    """Places of non-zero numbers, ordered by the ``depth`` numbers from there
    (at least); ``key`` packs the first ``words`` of them."""
    places = np.flatnonzero(codes)
    order = places[np.argsort(key[places])]
    ordered, n = key[order], len(order)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:n]
    rank = np.zeros(len(codes), np.int64)
    rank[order] = 1 + np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = order[~(new & np.concatenate([new[1:], [True]])[:n])]
    while len(tied) and words < depth:
        second = np.where(tied + words < len(codes), rank[np.minimum(tied + words, len(codes) - 1)], 0)
        at = np.lexsort((second, rank[tied]))
        tied, second = tied[at], second[at]
        first = rank[tied]
        group = np.concatenate([[True], first[1:] != first[:-1]])
        new = group | np.concatenate([[True], second[1:] != second[:-1]])
        count = np.arange(len(tied))
        rank[tied] = first + np.maximum.accumulate(np.where(new, count, 0)) - np.maximum.accumulate(np.where(group, count, 0))
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        words *= 2
    return places[np.argsort(rank[places], kind="stable")]


def common(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many numbers from ``a[x]`` and ``b[y]`` on agree; the first
    ``start`` do. A zero ends a run; both arrays end in one."""
    length, active = start.copy(), np.arange(len(x))
    while len(active):
        u, v = a[x[active] + length[active]], b[y[active] + length[active]]
        active = active[(u == v) & (u > 0)]
        length[active] += 1
    return length


class Block:
    """Some items of the benchmark: words, sorted suffixes, windows."""

    def __init__(self, pieces: pa.Table, window: int) -> None:
        self.window = window
        words, counts = split_words(as_bytes(pieces["words"].combine_chunks()))
        self.vocabulary = words.unique()
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.packs = min(window, KEY_BITS // self.bits)
        # a zero after each piece
        ends = np.cumsum(counts + 1) - 1
        self.codes = np.zeros(int((counts + 1).sum()) + 1, np.int32)
        inside = np.ones(len(self.codes), bool)
        inside[ends] = inside[-1] = False
        self.codes[inside] = self.numbers(words)
        ids = pc.fill_null(pieces["item"].combine_chunks().cast(pa.large_string()), "")
        self.items, named = ids.unique(), pieces["item"].is_valid().to_numpy()
        number = np.where(named, pc.index_in(ids, value_set=self.items).to_numpy(zero_copy_only=False), -1)
        owner = np.repeat(np.arange(len(counts)), counts + 1)
        key = packed(self.codes, self.bits, self.packs)
        self.order = sorted_suffixes(self.codes, key, self.packs, int(counts.max(initial=1)))
        # suffixes that hold a window, or are a short item, in order
        left = ends[owner[self.order]] - self.order
        short = counts[owner[self.order]] < window
        whole = short & (left == counts[owner[self.order]])
        place = np.flatnonzero((left >= window) | whole)
        starts, size = self.order[place], np.where(left[place] >= window, window, left[place])
        padded = np.concatenate([self.codes, np.zeros(window, np.int32)])
        grams = padded[starts[:, None] + np.arange(window)] * (np.arange(window) < size[:, None]) if len(starts) else np.zeros((0, window), np.int32)
        new = np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)])[: len(starts)]
        self.grams, self.sizes = grams[new], size[new]
        gram = np.cumsum(new) - 1
        gram, item = distinct(gram, number[owner[starts]])
        self.item_cuts = np.searchsorted(gram[item >= 0], np.arange(len(self.grams) + 1))
        self.gram_items = item[item >= 0]
        self.keys = packed_rows(self.grams, self.bits, self.packs)
        self.low, self.high = bounds(self.codes, self.order, key[self.order], self)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """1 and up for words of the vocabulary, 0 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order."""
    at = np.lexsort((b, a))
    a, b = a[at], b[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return a[new], b[new]


def packed_rows(grams: np.ndarray, bits: int, words: int) -> np.ndarray:
    key = np.zeros(len(grams), np.int64)
    for k in range(words):
        key = (key << bits) | grams[:, k]
    return key


def bounds(codes: np.ndarray, order: np.ndarray, keys: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Range in ``order`` of the suffixes that begin with each window."""
    rest = np.maximum(block.packs - block.sizes, 0) * block.bits
    low, high = np.searchsorted(keys, block.keys, "left"), np.searchsorted(keys, block.keys + (np.int64(1) << rest), "left")
    for k in range(block.packs, block.window):
        some = np.flatnonzero((low < high) & (block.sizes > k))
        # suffixes of a range share k words, so the next word is sorted in it
        a, b, wanted = low[some], high[some], block.grams[some, k]
        low[some], high[some] = (bisected(codes, order, a, b, k, wanted + side) for side in (0, 1))
    return low, high


def bisected(codes: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """First place in each range whose suffix has ``least`` or more at ``k``."""
    low, high = low.copy(), high.copy()
    while (going := np.flatnonzero(low < high)).size:
        mid = (low[going] + high[going]) // 2
        less = codes[order[mid] + k] < least[going]
        low[going[less]], high[going[~less]] = mid[less] + 1, mid[~less]
    return low


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) for every place of every range."""
    sizes = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]


def longest_runs(codes: np.ndarray, places: np.ndarray, gram: np.ndarray, block: Block) -> np.ndarray:
    """Longest run of words shared with an item from each place on, where a
    window stands; 0 where a longer run begins before it."""
    low, high = block.low[gram].copy(), block.high[gram].copy()
    only = block.order[low]
    before = np.where(places > 0, codes[places - 1], 0)
    inner = (high - low == 1) & (only > 0) & (before > 0) & (before == block.codes[only - 1])
    places, some = places[~inner], ~inner
    low, high = low[some], high[some]
    start, top, bottom = block.sizes[gram][some].astype(np.int64), high - 1, low.copy()
    while (going := np.flatnonzero(low < high)).size:
        mid = (low[going] + high[going]) // 2
        own, here = block.order[mid], places[going]
        same = common(codes, here, block.codes, own, start[going])
        less = block.codes[own + same] < codes[here + same]
        low[going[less]], high[going[~less]] = mid[less] + 1, mid[~less]
    out = np.zeros(len(some), np.int64)
    beside = [common(codes, places, block.codes, block.order[np.clip(at, bottom, top)], start) for at in (low - 1, low)]
    out[some] = np.maximum(*beside)
    return out


def search_shard(texts: list[bytes], block: Block) -> Iterator[tuple[int, np.ndarray, list[str], int]]:
    """Per text: words, spans of hit words (first, end, first, ..), items,
    longest shared run."""
    words, counts = split_words(texts)
    starts = np.cumsum(counts + 1) - counts - 1
    codes = np.zeros(int((counts + 1).sum()) + 1, np.int32)
    inside = np.ones(len(codes), bool)
    inside[starts + counts] = inside[-1] = False
    codes[inside] = block.numbers(words)
    key = packed(codes, block.bits, block.packs)
    order = sorted_suffixes(codes, key, block.packs, block.window)
    gram, at = expand(*bounds(codes, order, key[order], block))
    places = order[at]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + block.sizes[gram], -1)
    hit = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
    turns = np.diff(hit)
    first, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    doc = np.searchsorted(starts, places, "right") - 1
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, longest_runs(codes, places, gram, block))
    doc, gram = distinct(doc, gram)
    which, item = expand(block.item_cuts[gram], block.item_cuts[gram + 1])
    doc, item = distinct(doc[which], block.gram_items[item])
    span_cuts = np.searchsorted(first, np.append(starts, len(codes)))
    item_cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    names = block.items.take(pa.array(item, pa.int64())).to_pylist()
    for i, n in enumerate(counts.tolist()):
        a, b = span_cuts[i], span_cuts[i + 1]
        spans = np.stack([first[a:b], end[a:b]], axis=1).ravel() - starts[i]
        yield n, spans, names[item_cuts[i] : item_cuts[i + 1]], int(longest[i])


def united(a: list[int], b: list[int]) -> list[int]:
    """Spans of either list, as disjoint ones in order."""
    out: list[int] = []
    for first, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def test_blocks(benchmark: DataFrame, window: int, **columns: str) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, at least one."""
    pieces = stored(item_pieces(benchmark, window, **columns), "benchmark")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = -(-total // BLOCK_WORDS) or 1
    for k in range(n):
        yield Block(pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k).select("item", "words").toArrow(), window)


test_blocks.__test__ = False


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, hits, items, longest``, one row per document.

    ``hits`` holds spans of hit words (first, end, first, end, ..), ``items``
    the distinct ids in order, ``longest`` the most words in a row that the
    text shares with an item, 0 if no window occurs.
    """
    rows, spark = doc_table(docs), docs.sparkSession
    test = list(map(spark.sparkContext.broadcast, test_blocks(benchmark, window)))
    for k, block in enumerate(test):
        rows = searched(rows, block, first=k == 0, last=k == len(test) - 1)
        if k % CHAIN == CHAIN - 1 and k < len(test) - 1:
            rows = stored(rows, "searched")
    return rows.drop("text")


def searched(rows: DataFrame, block, first: bool, last: bool) -> DataFrame:
    """Search one block; what earlier blocks found is joined in."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch["text"])
        found = []
        for a, b in blocks(texts, SHARD_BYTES):
            found += search_shard(texts[a:b], block.value)
            give_back()
        n_words, hits, items, longest = (list(v) for v in zip(*found)) if found else ([], [], [], [])
        if not first:
            hits = [united(x.tolist(), y) if y else x for x, y in zip(hits, batch["hits"].to_pylist())]
            items = [[*x, *y] for x, y in zip(items, batch["items"].to_pylist())]
            longest = [max(x, y) for x, y in zip(longest, batch["longest"].to_pylist())]
        return {
            "doc_id": batch["doc_id"], "text": pa.nulls(len(texts), pa.string()) if last else batch["text"], "n_words": n_words,
            "n_hit": [int(sum(h[1::2]) - sum(h[::2])) for h in hits], "hits": hits, "items": [sorted(set(x)) for x in items], "longest": longest,
        }

    return batched(rows, work, f"doc_id long, text string, {FOUND}")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(docs.schema)

    def without(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = as_bytes(batch.column(batch.schema.names.index(text_col)).cast(pa.string()))
                clean = [not len(spans) for a, b in blocks(texts, SHARD_BYTES) for _, spans, _, _ in search_shard(texts[a:b], block.value)]
                kept = batch.filter(pa.array(clean, pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns, schema=out)

        return run

    for block in test_blocks(benchmark, window):
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
