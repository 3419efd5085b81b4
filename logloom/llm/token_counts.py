"""Exact token counts of every prefix of a text.

A sentence-piece BPE vocabulary has no piece with a space after another
letter, so a text falls into segments (spaces, then what follows them up to
the next space) that are encoded independently. Two prefix tables follow:

* across segments, ``counts[i]`` holds the tokens of the text up to the end of
  segment i (a running sum, stored per document);
* inside a segment, ``PrefixBpe`` fills the same table per letter: the tokens
  of a prefix are those of a shorter prefix plus one last token, and exactly
  one last token is compatible with the token before it.

Counts never fall from one segment to the next, so the longest prefix within a
budget lies in the last segment that starts within it: truncation looks up one
segment and encodes nothing else again.

Rules: null text is empty with no tokens; repeated rows give repeated rows;
null ids are kept; an empty input gives an empty result.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.frames import as_bytes, batched, blocks, doc_table, keeps
from logloom.llm.word_tokens import tokenizer_path

PIECE_BPE = "piece_bpe_32k.model"
SPACE = "▁"
# Segments that a task remembers; beyond it the memory starts anew.
MEMORY_SEGMENTS = 300_000


def segments(text: bytes) -> list[bytes]:
    """Segments, each without the one space that stands before it."""
    if not text:
        return []
    if (mark := SPACE.encode()) in text:
        text = text.replace(mark, b" ")
    if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
        return [s[1:] for s in re.findall(rb" +[^ ]*", b" " + text)]
    return text.split(b" ")


class SegmentCounter:
    def __init__(self, path: str, memory: int = MEMORY_SEGMENTS) -> None:
        import sentencepiece

        self.model, self.memory = sentencepiece.SentencePieceProcessor(model_file=path), memory
        self.known = {b"": 1}

    def prefix_counts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text the tokens up to the end of each segment."""
        out = []
        for a, b in blocks(texts):
            split = [segments(t) for t in texts[a:b]]
            fresh = set().union(*split).difference(self.known)
            if len(self.known) + len(fresh) > self.memory:
                self.known = {b"": 1}
                fresh = set().union(*split).difference(self.known)
            fresh = list(fresh)
            found = self.model.encode([s.decode("utf-8", "replace") for s in fresh], num_threads=1)
            self.known.update(zip(fresh, map(len, found)))
            out += [np.cumsum(np.fromiter(map(self.known.__getitem__, s), np.int32, len(s)), dtype=np.int32) for s in split]
        return out


class PrefixBpe:
    """Tokens of every prefix of one segment, letter by letter."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        self.longest = max(map(len, self.score))
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text: best-scored merge first, then leftmost."""
        parts = list(text)
        while True:
            best = max(((self.score[p + q], -i) for i, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, before: str, token: str) -> bool:
        key = (before, token)
        if key not in self.fits:
            if len(self.fits) > MEMORY_SEGMENTS:
                self.fits.clear()
            self.fits[key] = self.merged(before + token) == [p for p in key if p]
        return self.fits[key]

    def counts(self, segment: str) -> list[int]:
        """``counts[k]``: tokens of the first k letters. A letter without a
        piece is as many tokens as it has bytes."""
        counts, last = [0], [""]
        for k in range(1, len(segment) + 1):
            for n in range(1, min(self.longest, k) + 1):
                token = segment[k - n : k]
                if (n == 1 or token in self.score) and self.follows("", token) and self.follows(last[k - n], token):
                    counts.append(counts[k - n] + (1 if token in self.score else len(token.encode())))
                    last.append(token)
                    break
        return counts


def _place(model: str) -> str:
    return model if os.path.isabs(model) else tokenizer_path(model)


@keeps
def segment_counter(model: str) -> SegmentCounter:
    return SegmentCounter(_place(model))


@keeps
def prefix_bpe(model: str) -> PrefixBpe:
    return PrefixBpe(_place(model))


def prefix_counts(docs: DataFrame, model: str = PIECE_BPE, budget: int = -1) -> DataFrame:
    """``doc_id, text, n_bytes, counts``: the prefix table of each document.
    Texts of at most ``budget`` tokens are left out, for nothing in them is cut."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch["text"])
        counts = segment_counter(model).prefix_counts(texts)
        over = pa.array([len(c) > 0 and int(c[-1]) > budget or budget < 0 for c in counts], pa.bool_())
        return {"doc_id": batch["doc_id"], "text": pc.if_else(over, batch["text"], None), "n_bytes": [len(t) for t in texts], "counts": counts}

    return batched(doc_table(docs), work, "doc_id long, text string, n_bytes long, counts array<int>", uses=(segment_counter,))


def token_totals(docs: DataFrame, limit: int, model: str = PIECE_BPE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` from the end of each table."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch["text"])
        tables = segment_counter(model).prefix_counts(texts)
        return {"doc_id": batch["doc_id"], "n_bytes": [len(t) for t in texts], "n_tokens": [int(c[-1]) if len(c) else 0 for c in tables]}

    return batched(doc_table(docs), work, "doc_id long, n_bytes long, n_tokens long", uses=(segment_counter,)).withColumn("over_limit", F.col("n_tokens") > limit)


def inner_counts(segment: bytes, model: str = PIECE_BPE) -> list[int]:
    """Tokens of a segment's prefixes; entry 0 is the segment's space alone
    not yet read, entry k counts the space and k letters."""
    return prefix_bpe(model).counts(SPACE + segment.decode("utf-8", "replace").replace(" ", SPACE))


def longest_prefix(text: str, counts: list[int] | np.ndarray, budget: int, model: str = PIECE_BPE) -> str:
    """The longest prefix of at most ``budget`` tokens."""
    split = segments(text.encode())
    starts = np.concatenate([[0], np.asarray(counts, np.int64)])[: len(split)]
    at = int(np.searchsorted(starts, budget, "right")) - 1
    if at < 0 or not split:
        return ""
    # letters before the segment's own space; the first segment's space is not in the text
    before = max(0, sum(len(s.decode("utf-8", "replace")) + 1 for s in split[:at]) - 1)
    # no token is longer than the longest piece, so what fits is this short
    most = (budget - int(starts[at])) * prefix_bpe(model).longest
    inner = inner_counts(split[at].decode("utf-8", "replace")[:most].encode(), model)
    keep = max(k for k, n in enumerate(inner) if starts[at] + n <= budget)
    return text[: before + keep - (at == 0 and keep > 0)]


def truncated(table: DataFrame, budget: int, model: str = PIECE_BPE) -> DataFrame:
    """``doc_id, text`` cut to ``budget`` tokens, from a ``prefix_counts`` table."""

    def work(batch: pa.RecordBatch) -> dict:
        pairs = zip(batch["text"].to_pylist(), batch["counts"].to_pylist())
        return {"doc_id": batch["doc_id"], "text": [None if t is None else longest_prefix(t, c, budget, model) for t, c in pairs]}

    return batched(table.select("doc_id", "text", "counts"), work, "doc_id long, text string", uses=(prefix_bpe,))


def budgeted(table: DataFrame, budget: int, model: str = PIECE_BPE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, prefix_bytes`` from a
    ``prefix_counts`` table: the last entry, and the bytes of the longest prefix
    of at most ``budget`` tokens. Only texts beyond the budget go to Python, and
    only they need to be in the table."""

    def work(batch: pa.RecordBatch) -> dict:
        cut = [None if t is None else len(longest_prefix(t.decode("utf-8", "replace"), c, budget, model).encode()) for t, c in zip(batch["text"].to_pylist(), batch["counts"].to_pylist())]
        return {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": batch["n_tokens"], "prefix_bytes": [n if k is None else k for n, k in zip(batch["n_bytes"].to_pylist(), cut)]}

    tokens = F.coalesce(F.get("counts", F.size("counts") - 1), F.lit(0)).cast("long")
    over = tokens > budget
    chosen = table.select("doc_id", "n_bytes", tokens.alias("n_tokens"), F.when(over, F.col("text").cast("binary")).alias("text"), F.when(over, F.col("counts")).alias("counts"))
    cut = batched(chosen, work, "doc_id long, n_bytes long, n_tokens long, prefix_bytes long", uses=(prefix_bpe,))
    return cut.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "prefix_bytes")
