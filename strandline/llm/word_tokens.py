"""Ids of the word-level BPE tokenizer, with a bounded cache of words in each worker.

No token crosses an ASCII space or line feed, so a text's ids are those of its parts between them. Parts of plain
ASCII and Latin letters are cut and looked up here and merged by the tokenizer's own model; all others go through the
whole tokenizer.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np

from .arrow import KEPT

#: Words that a worker remembers; it starts anew when they are this many, so memory stays bounded (some 250 bytes a word, two generations).
CACHE_WORDS = 200_000
#: Longer words (in characters) are not remembered.
CACHE_CHARS = 40

PLAIN = re.compile("[!-~À-ÖØ-öø-į]+")
#: The tokenizer's own cut of a lower-case text, for the characters of PLAIN.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE shows for each byte: itself where printable, else the next after 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Cache(dict):
    """Computes what it lacks and remembers it for two generations: when it is full it starts anew, and what is still
    used comes back from the generation before."""

    def __init__(self, compute: Callable[[str], bytes]):
        self.compute, self.old = compute, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= CACHE_CHARS:
            self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class WordTokens:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.parts = Cache(self._part)
        self.words = Cache(self._word)

    def _by_library(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        found = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(found)}I", *found)

    def _word(self, word: str) -> bytes:
        if word.isascii():
            low = word.lower()
            if word.isalpha():  # one entry, under the word itself
                return self._part(word) if low == word else self.words[low]
            if word[:-1].isalpha() and word[-1] in ",.":
                return self.words[low[:-1]] + self.parts[word[-1]]
        if not PLAIN.fullmatch(word) or "<|" in word:
            return self._by_library(word) if word else b""
        return b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))

    def encode(self, text: str) -> bytes:
        self.words.turn()
        self.parts.turn()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def word_tokens(path: str, owner: str = "strandline.llm.packing") -> WordTokens:
    """One encoder per worker and file: its cache serves all the tasks of its owner, a module, that the worker runs until it runs others."""
    loaded = KEPT.setdefault(owner, {})
    if path not in loaded:
        loaded[path] = WordTokens(path)
    return loaded[path]
