"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Induced sorting fills one first-letter bucket at a time; a bucket is a few
array operations, so the interpreter's work grows with the alphabet and the
arrays' work with the text. The string of leftmost-smaller substring names has
an alphabet as large as itself, so its suffixes are sorted by doubling ranks,
refining only groups that are still tied.
"""

from __future__ import annotations

import numpy as np

NONE = np.zeros(0, np.int64)


def _types(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them."""
    n = len(s)
    at = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    decided = np.minimum.accumulate(at[::-1])[::-1]
    return np.concatenate([(s[:-1] < s[1:])[decided], [True]])


def _deal(lists: list[list[np.ndarray]], where: np.ndarray, values: np.ndarray) -> None:
    """Append values to the lists named, keeping their order."""
    if not len(values):
        return
    order = np.argsort(where, kind="stable")
    where, values = where[order], values[order]
    cuts = np.flatnonzero(where[1:] != where[:-1]) + 1
    for part, c in zip(np.split(values, cuts), where[np.concatenate([[0], cuts])].tolist()):
        lists[c].append(part)


def _extended(s: np.ndarray, first: np.ndarray, letter: int) -> np.ndarray:
    """A bucket's entries with those that they induce in the same bucket."""
    parts, front = [first], first
    while len(front):
        front = front[front > 0] - 1
        front = front[s[front] == letter]
        parts.append(front)
    return np.concatenate(parts)


def _induce(s: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in order."""
    letters = int(s.max()) + 1
    starts: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _deal(starts, s[smallest], smallest)
    large: list[list[np.ndarray]] = [[] for _ in range(letters)]
    filled: list[np.ndarray] = []
    for c in range(letters):
        filled.append(_extended(s, np.concatenate([NONE, *large[c]]), c))
        before = np.concatenate([filled[c], *starts[c]])
        before = before[before > 0] - 1
        letter = s[before]
        _deal(large, letter[letter > c], before[letter > c])
    small: list[list[np.ndarray]] = [[] for _ in range(letters)]
    small[0].append(np.array([len(s) - 1]))
    out: list[np.ndarray] = []
    for c in range(letters - 1, -1, -1):
        ends = _extended(s, np.concatenate([NONE, *small[c]]), c) if c else small[0][0]
        before = np.concatenate([ends, filled[c][::-1]])
        before = before[before > 0] - 1
        letter = s[before]
        _deal(small, letter[letter < c], before[letter < c])
        out += [ends[::-1], filled[c]]
    return np.concatenate(out[::-1])


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = names[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    tied = order[~(new & np.concatenate([new[1:], [True]]))]
    while len(tied):
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        tied = tied[np.lexsort((second, rank[tied]))]
        after = tied + step
        first, second = rank[tied], np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = np.concatenate([[True], first[1:] != first[:-1]])
        new = group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(tied))
        rank[tied] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of the suffixes of a byte array, in order."""
    if not len(text):
        return NONE
    s = np.concatenate([text.astype(np.uint16) + 1, np.zeros(1, np.uint16)])
    kind = _types(s)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = _induce(s, lms)
    order = order[is_lms[order]]
    length = np.empty(len(s), np.int64)
    length[lms] = np.diff(np.concatenate([lms, [len(s) - 1]])) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    active, offset = np.flatnonzero(same), 0
    while len(active):
        active = active[offset < length[a[active]]]
        differ = s[a[active] + offset] != s[b[active] + offset]
        same[active[differ]] = False
        active, offset = active[~differ], offset + 1
    if same.any():
        name = np.empty(len(s), np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        order = lms[_by_doubling(name[lms])]
        order = _induce(s, order)
    else:
        order = _induce(s, order)
    return order[1:]


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Per place the common prefix with the suffix before it in order.

    A place whose letter before equals that of its predecessor's has one less
    than the place before it; only the others are compared, eight bytes at a
    time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    reduced = (i > 0) & (before > 0)
    reduced[reduced] = text[i[reduced] - 1] == text[before[reduced] - 1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = padded[:n].copy()
    for k in range(1, 8):
        words |= padded[k : n + k] << np.uint64(8 * k)
    common = np.zeros(n, np.int64)
    active = np.flatnonzero(~reduced & (before >= 0))
    while len(active):
        x, y = active + common[active], before[active] + common[active]
        room = n - np.maximum(x, y)
        active, x, y, room = active[room > 0], x[room > 0], y[room > 0], room[room > 0]
        differ = words[x] ^ words[y]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(float)).astype(np.int64) >> 3)
        common[active] += np.minimum(equal, room)
        active = active[(differ == 0) & (room > 8)]
    anchor = np.maximum.accumulate(np.where(reduced, 0, i))
    return np.where(before < 0, 0, common[anchor] - (i - anchor))
