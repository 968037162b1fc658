"""Exact, memoised use of the two BPE tokenizers of the tokenizers library.

Both split a text into pieces first and merge inside a piece only, so the ids of a
text are its pieces' ids in a row. The library encodes each distinct piece once per
worker and bounded memo; texts that the split below doesn't cover (characters beyond
Latin-1, special strings) go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .shared import worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Character classes of Latin-1, spelled out so that they equal the tokenizers' classes.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_DIGIT = "0-9²³¹¼½¾"
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_CLITIC = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_SPLIT = re.compile(f"{_CLITIC}|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
BYTE_SPLIT = re.compile(f"{_CLITIC}| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PLAIN = re.compile(f" ?[{_LETTER}]+")

class Memo(dict):
    """What pieces are known to encode to: two generations of bounded size, so that
    pieces in use stay while others go."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries, self.old = entries, {}

    def missing(self, pieces: set[str]) -> list[str]:
        """Those of pieces that are to be learned; makes room, and keeps the others at hand."""
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()
        new = pieces.difference(self)
        again = new.intersection(self.old)
        self.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return list(new.difference(again))


def load(path: str):
    """The library's tokenizer at path, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


class WordEncoder:
    """ids of texts, as packed little-endian unsigned 32-bit bytes, under a tokenizer
    that lower-cases, drops white space and marks word ends."""

    def __init__(self, path: str, entries: int = 100_000):
        self.library, self.memo = load(path), Memo(entries)
        self.ends = np.array([t.endswith("</w>") for t, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])])

    def _learn(self, words: set[str]) -> None:
        new = self.memo.missing(words)
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            ids = np.asarray(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")  # without the ids' places in the text
            cut = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            if len(cut) == len(part) + 1 and cut[-1] == 4 * len(ids):
                data = ids.tobytes()
                self.memo.update(zip(part, [data[a:z] for a, z in zip(cut, cut[1:], strict=False)], strict=True))
            else:  # a piece is not closed by a word end
                self.memo.update((w, pack(self.library.encode(w, add_special_tokens=False).ids)) for w in part)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts of one slice (see by_bytes): their words are held at once."""
        split = [WORD_SPLIT.findall(t.lower()) if latin(t) else None for t in texts]
        words: set[str] = set()
        for s in split:
            if s:
                words.update(s)
        self._learn(words)
        get = self.memo.__getitem__
        return [pack(self.library.encode(t, add_special_tokens=False).ids) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


class ByteCounter:
    """Token counts of texts under a byte-level BPE."""

    def __init__(self, library, entries: int = 100_000):
        self.library, self.memo = library, Memo(entries)
        ids = self.library.encode("\n", add_special_tokens=False).ids
        self.newline = ids[0] if len(ids) == 1 else None

    def _count(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: set[str]) -> None:
        new = self.memo.missing(pieces)
        plain = [w for w in new if self.newline is not None and _PLAIN.fullmatch(w)]
        for w in set(new) - set(plain):
            self.memo[w] = self._count(w)
        for k in range(0, len(plain), 2000):  # a newline is a piece of its own between such pieces
            part = plain[k : k + 2000]
            counts, n = [], 0
            for x in self.library.encode("\n".join(part), add_special_tokens=False).ids:
                if x == self.newline:
                    counts.append(n)
                    n = 0
                else:
                    n += 1
            counts.append(n)
            if len(counts) != len(part):
                counts = [self._count(w) for w in part]
            self.memo.update(zip(part, counts, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = [BYTE_SPLIT.findall(t) if latin(t) else None for t in texts]
        pieces: set[str] = set()
        for s in split:
            if s:
                pieces.update(s)
        self._learn(pieces)
        get = self.memo.__getitem__
        return [self._count(t) if s is None else sum(map(get, s)) for t, s in zip(texts, split, strict=True)]


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker: tasks that follow each other share its memo."""
    return worker_state(("word", path), lambda: WordEncoder(path))
