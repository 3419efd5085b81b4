"""Statistics of one text, computed when first asked for.

Words are runs of anything but ASCII white space, lines are cut at line feeds.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = b".,;:!?\"'()-"
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCT = np.zeros(256, bool)
PUNCT[list(PUNCTUATION)] = True


def repeated_windows(ids: np.ndarray, distinct: int) -> np.ndarray:
    """Which words lie in a window of three that occurs at least twice."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < 4:
        return covered
    pair = ids[:-2] * distinct + ids[1:-1]
    if distinct >= 1 << 21:  # keep the products exact
        pair = np.unique(pair, return_inverse=True)[1]
    windows = pair * distinct + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        again = np.isin(windows, twice)
        for i in range(3):
            covered[i : len(ids) - 2 + i] |= again
    return covered


class DocStats:
    def __init__(self, data: bytes) -> None:
        self.data = data

    @cached_property
    def text(self) -> str:
        return self.data.decode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.data.count, WHITE.encode()))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.data.count, SYMBOLS.encode()))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [line for line in self.data.split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> tuple[np.ndarray, int]:
        index = dict.fromkeys(self.words)
        index = dict(zip(index, range(len(index))))
        return np.fromiter(map(index.__getitem__, self.words), np.int64, self.n_words), len(index)

    @cached_property
    def n_repeat_words(self) -> int:
        return int(repeated_windows(*self.word_ids).sum())

    @cached_property
    def byte_counts(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.data, np.uint8), minlength=256)

    def share(self, kind: np.ndarray, of: np.ndarray | None = None) -> float:
        """Bytes of a kind among all bytes or those of another kind."""
        total = self.byte_counts.sum() if of is None else self.byte_counts[of].sum()
        return float(self.byte_counts[kind].sum() / total) if total else 0.0

    def per_word(self, n: float) -> float:
        return n / self.n_words if self.n_words else 0.0

    @cached_property
    def word_frequencies(self) -> np.ndarray:
        ids, n = self.word_ids
        return np.bincount(ids, minlength=n)

    @cached_property
    def top_word_share(self) -> float:
        return self.per_word(self.word_frequencies.max(initial=0))

    @cached_property
    def word_lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.words), np.int64, self.n_words)


def entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


FEATURES = (
    "log_words", "mean_word", "spread_word", "longest_word", "short_words", "upper_share", "digit_share", "symbols_per_word",
    "punctuation_per_word", "shouts_per_word", "stops_per_word", "distinct_share", "top_word_share", "repeat_share", "word_entropy",
    "byte_entropy", "non_ascii_share", "log_lines", "words_per_line", "dup_line_share", "ended_lines", "line_spread", "alnum_share",
)


def features(data: bytes) -> list[float]:
    """The statistics named in ``FEATURES``; all zero for an empty text."""
    d = DocStats(data)
    if not d.n_words:
        return [0.0] * len(FEATURES)
    lengths, lines = d.word_lengths, d.lines
    per_line = np.fromiter((line.count(b" ") + 1 for line in lines), np.int64, len(lines))
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?", b'"', b"\xbb") for line in lines)
    high = np.arange(256) >= 128
    counts = d.byte_counts
    return [
        math.log1p(d.n_words), float(lengths.mean()), float(lengths.std()), float(lengths.max()), float((lengths <= 3).mean()), d.share(UPPER, LETTER),
        d.share(DIGIT), d.per_word(d.n_symbols), d.per_word(counts[PUNCT].sum()), d.per_word(counts[33]), d.per_word(counts[46]), d.per_word(len(d.word_frequencies)),
        d.top_word_share, d.per_word(d.n_repeat_words), entropy(d.word_frequencies) / math.log2(d.n_words + 1), entropy(counts), d.share(high),
        math.log1p(len(lines)), float(per_line.mean()), d.n_dup_lines / len(lines), ended / len(lines), float(per_line.std() / per_line.mean()), d.share(ALNUM),
    ]
