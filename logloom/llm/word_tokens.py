"""Token ids of a word-level BPE tokenizer, one encoding per distinct word.

The tokenizer drops white space and never merges across it, so the ids of a
text are the ids of its white-space separated words in order. Each task keeps
the words it has met in a bounded dictionary and hands only new ones to the
tokenizers library.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logloom.llm.frames import keeps, ranges

WORD_BPE = "word_bpe_49k.json"
# Words that a worker remembers.
MEMORY_WORDS = 200_000
# Bytes of text whose distinct words are numbered at once.
SLICE_BYTES = 4 << 20
# Letters that are one code point each, lowered one by one and in NFC as they
# are, then a run of ASCII marks, which is one token unit.
PLAIN = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{132}-\x{17e}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters are themselves, others count up from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Values of the keys met, at most ``most`` of them; when full, it starts
    anew and takes over what it meets again of the full one."""

    def __init__(self, most: int, find: Callable[[list], list]) -> None:
        self.most, self.find, self.known, self.older = most, find, {}, {}

    def __call__(self, keys: list) -> list:
        """Values of distinct keys."""
        fresh = set(keys).difference(self.known)
        if len(self.known) + len(fresh) > self.most:
            self.known, self.older = {}, self.known
            fresh = set(keys)
        again = fresh.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new = list(fresh.difference(again))
        if new:
            self.known.update(zip(new, self.find(new), strict=True))
        return list(map(self.known.__getitem__, keys))


class WordEncoder:
    """Words of plain letters, marks after them or not, are lowered here and
    go to the BPE model many at a time; the word-end marks of the vocabulary
    show where each ends. All others go through the tokenizer's own normaliser
    and splitter one by one. Arrow splits texts and words and numbers what is
    distinct, so Python sees each distinct run of letters once a slice.
    """

    def __init__(self, path: str, memory: int = MEMORY_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)  # the same model without normaliser and splitter
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.shown = dict(enumerate(byte_letters()))
        self.letters, self.marks = Memory(memory, self.together), Memory(memory, self.one_by_one)

    def one_by_one(self, words: list[str]) -> list[bytes]:
        return [array("I", f.ids).tobytes() for f in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(self.shown) for w in words]
        ids = np.array(self.model.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def words(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        parts = pc.extract_regex(distinct, pattern=PLAIN)
        found = []
        for part, memory in ((pc.utf8_lower(pc.struct_field(parts, 0)), self.letters), (pc.struct_field(parts, 1), self.marks)):
            numbered = part.filter(parts.is_valid()).dictionary_encode()
            found.append(pa.array(memory(numbered.dictionary.to_pylist()), pa.large_binary()).take(numbered.indices))
        plain = pc.binary_join_element_wise(*found, pa.scalar(b"", pa.large_binary()))
        other = pa.array(self.one_by_one(distinct.filter(parts.is_null()).to_pylist()), pa.large_binary())
        place = np.empty(len(distinct), np.int64)
        is_plain = parts.is_valid().to_numpy(zero_copy_only=False)
        place[is_plain], place[~is_plain] = np.arange(len(plain)), len(plain) + np.arange(len(other))
        return pa.concat_arrays([plain, other]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for a, b in ranges(sizes, SLICE_BYTES):
            words = pc.ascii_split_whitespace(texts.slice(a, b - a))
            numbered = words.flatten().dictionary_encode()
            if not len(numbered):
                out += [b""] * len(words)
                continue
            ids = self.words(numbered.dictionary).take(numbered.indices)
            places = np.frombuffer(ids.buffers()[1], np.int64)[words.offsets.to_numpy() - words.offsets[0].as_py()]
            raw = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
            out += [raw[x:y] for x, y in zip(places.tolist(), places[1:].tolist())]
        return out


@keeps
def encoder(name: str) -> WordEncoder:
    """One encoder per Python worker, kept between tasks that encode."""
    return WordEncoder(name if os.path.isabs(name) else tokenizer_path(name))
