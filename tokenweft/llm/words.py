"""Words of whole texts as hashes: split on ASCII white space, hashed through a bounded cache, combined with numpy over blocks of texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from tokenweft.llm._common import held

#: Byte classes of a word's shape: capitals A, small letters and all bytes beyond ASCII a, digits 0; other bytes stay.
_CLASSES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(?<=a)a+|(?<=A)A+|(?<=0)0+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    r"""Matches of [^\x20\x09-\x0D]+ as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shape(word: bytes) -> bytes:
    """The word's byte classes, runs of letters and of digits cut to one."""
    classes = word.translate(_CLASSES)
    return b"a" if classes.count(b"a") == len(classes) else _RUNS.sub(b"", classes)


class WordTable(dict):
    """word -> row; `hashes` and, if asked for, `shapes` are arrays by row. Emptied between batches once it holds `most` words or 100 bytes for each of them."""

    def __init__(self, shapes: bool = False, most: int = 500_000):
        super().__init__()
        self.with_shapes, self.most = shapes, most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self._hashes = np.empty(1 << 16, np.uint64)
        self._shapes = np.empty(1 << 16, np.uint64)
        self.done = self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        self.bytes += len(word)
        return row

    def trim(self) -> None:
        if len(self) > self.most or self.bytes > 100 * self.most:
            self._reset()

    def rows(self, found: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.new:
            self._grow()
        return out

    def _grow(self) -> None:
        while len(self) > len(self._hashes):
            self._hashes = np.concatenate([self._hashes, np.empty_like(self._hashes)])
            if self.with_shapes:
                self._shapes = np.concatenate([self._shapes, np.empty_like(self._shapes)])
        span = slice(self.done, self.done + len(self.new))
        self._hashes[span] = [xxhash.xxh64_intdigest(w) for w in self.new]
        if self.with_shapes:
            self._shapes[span] = [xxhash.xxh64_intdigest(shape(w), 1) for w in self.new]
        self.done += len(self.new)
        self.new = []

    def hashes(self, rows: np.ndarray) -> np.ndarray:
        return self._hashes[rows]

    def shapes(self, rows: np.ndarray) -> np.ndarray:
        return self._shapes[rows]


def word_table(shapes: bool) -> WordTable:
    """One table for each worker process."""
    return held(("words", shapes), lambda: WordTable(shapes))


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    x = (a * MIX) ^ (b + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n; none where the array is shorter."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - n + 1]
    for i in range(1, n):
        out = mix(out, hashes[i : len(hashes) - n + 1 + i])
    return out


class Block:
    """The words of several texts at once: `rows` of all words, `doc` the text that each is in."""

    def __init__(self, table: WordTable, texts: list[str | None]):
        table.trim()
        found = [words(t) for t in texts]
        self.table, self.texts = table, texts
        self.counts = np.array([len(w) for w in found], np.int64)
        self.rows = table.rows([w for ws in found for w in ws])
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, texts) of all windows of n words that lie in one text."""
        if len(hashes) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        inside = self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :]
        return grams(hashes, n)[inside], self.doc[: len(self.doc) - n + 1][inside]

    def features(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, texts) of hashed n-grams, with repeats: words, and windows of 1 to 3 word shapes; a shape says if its word repeats the one before."""
        plain, shapes = self.table.hashes(self.rows), self.table.shapes(self.rows)
        again = np.zeros(len(self.rows), np.uint64)
        again[1:] = (self.rows[1:] == self.rows[:-1]) & (self.doc[1:] == self.doc[:-1])
        shapes = shapes ^ (again * MIX)
        parts = [(plain, self.doc), *(self.windows(shapes, n) for n in (1, 2, 3))]
        return (np.concatenate([h for h, _ in parts]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([d for _, d in parts])
