"""Exact, cached byte-level BPE encoding on segments of text.

The pre-tokenising pattern never lets a match run from a non-space character into white space, so a text
may be cut before every run of white space and each part encoded alone: the ids joined are the ids of the
text. Texts are cut in blocks by Arrow, a block's distinct segments are looked up in a table, all that are new
are cut into pieces and encoded together, and the block's ids are gathered from the table's pool. A worker keeps
one table; once it weighs more than its bytes allow, only the segments met most often stay.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tokenweft.llm._common import held

#: Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The characters that end a word for the pattern's \s.
SPACES = " \t\n\x0b\x0c\r\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
RUNS = re.compile(f"[{SPACES}]+[^{SPACES}]*|[^{SPACES}]+")
#: Texts with these (for RE2) are cut by RUNS; all others have single blanks and line ends only.
_ODD = r"[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x00]|[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES[6:]) + "]"
#: The same pattern for texts of _LATIN alone, whose classes are listed here: quicker than by Unicode properties.
_LETTERS, _DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
_WORD, _LATIN = rf"^ ?[{_LETTERS}]+$", "^[ -~\xa1-\u024f]*$"
_SIMPLE = f"^ ?[^{SPACES}]+$"


def split(text: str) -> list[str]:
    """Parts whose encodings, joined, are the encoding of the whole text."""
    return RUNS.findall(text)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all ranges, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with one more id behind each."""
    return np.insert(ids, np.cumsum(counts), end_id).astype("<u4", copy=False), counts + 1


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Segments:
    """segment -> ids, for blocks of texts. `whole` are strings that no cut may touch: a text with one of them is one segment."""

    def __init__(self, whole: list[str] = (), most_bytes: int = 160_000_000):
        self.pattern, self.most = regex.compile(PATTERN), most_bytes
        self.odd = "|".join([_ODD, *map(re.escape, whole)])
        self.whole = [w for w in whole if w]
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.pool = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.uint32)
        self.uses = np.zeros(1 << 14, np.int64)
        self.used, self.weight = 0, 0

    def trim(self) -> None:
        """Over the weight allowed, keep the segments that were met most often, up to half of it."""
        if self.weight <= self.most:
            return
        names, n = list(self.rows), len(self.rows)
        sizes = 180 + np.fromiter(map(len, names), np.int64, n) + 4 * self.lengths[:n]
        order = np.argsort(-self.uses[:n], kind="stable")
        order = order[(np.cumsum(sizes[order]) <= self.most // 2) & (self.uses[:n][order] > 1)]
        order = np.sort(order[order > 0])
        kept, lengths, ids = [names[i] for i in order.tolist()], self.lengths[order], self.pool[spread(self.starts[order], self.lengths[order])]
        self._reset()
        self._add(kept, ids, lengths)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct matches of the pattern end to end, and the number of ids of each."""
        raise NotImplementedError

    def encode_whole(self, segment: str) -> list[int] | None:
        """Ids of a segment beyond _LATIN, if an encoder cuts such ones itself."""
        return None

    def _add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.rows), len(ids)
        while first + len(names) > len(self.starts):
            self.starts, self.lengths, self.uses = (np.append(x, np.zeros_like(x)) for x in (self.starts, self.lengths, self.uses))
        while self.used + n > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + n] = ids
        span = slice(first, first + len(names))
        self.lengths[span] = lengths
        self.starts[span] = self.used + np.cumsum(lengths) - lengths
        self.rows.update(zip(names, range(span.start, span.stop), strict=True))
        self.used += n
        self.weight += 180 * len(names) + sum(map(len, names)) + 4 * n

    def _add_pieces(self, pieces: list[str]) -> None:
        new = [p for p in pieces if p not in self.rows]
        if new:
            self._add(new, *self.encode_pieces(new))

    def learn(self, segments: pa.Array) -> None:
        """All new segments at once: every piece among them is encoded once, and kept as a segment too."""
        word = pc.match_substring_regex(segments, _WORD)
        several = pc.and_(pc.match_substring_regex(segments, _SIMPLE), pc.match_substring_regex(segments, _LATIN))
        for w in self.whole:
            word, several = (pc.and_not(x, pc.match_substring(segments, w)) for x in (word, several))
        several = pc.and_not(several, word)
        lone, rest = strings(segments.filter(word)), strings(segments.filter(pc.invert(pc.or_(several, word))))
        # a line end between two segments is a piece of its own, whatever stands beside it
        names = strings(segments.filter(several))
        found = [*_PIECES.findall("\n".join(names)), "\n"] if names else []
        with_lines = []
        for s in rest:
            ids = self.encode_whole(s) if not s.isascii() or any(w in s for w in self.whole) else None
            if ids is not None:
                self._add([s], np.array(ids, np.uint32), np.array([len(ids)]))
            else:
                own = self.pattern.findall(s)
                if "\n" in own:  # no separator here
                    with_lines.append((s, own))
                else:
                    names.append(s)
                    found += [*own, "\n"]
        self._add_pieces(list(dict.fromkeys([*lone, *found, *chain.from_iterable(own for _, own in with_lines)])))
        for s, own in with_lines:
            if len(own) > 1:
                ids = [self.pool[self.starts[r] : self.starts[r] + self.lengths[r]] for r in map(self.rows.__getitem__, own)]
                self._add([s], np.concatenate(ids), np.array([sum(map(len, ids))]))
        if not names:
            return
        rows = np.fromiter(map(self.rows.__getitem__, found), np.int64, len(found))
        ends = np.flatnonzero(rows == self.rows["\n"])
        counts = np.diff(ends, prepend=-1) - 1
        joined = counts > 1  # others are pieces themselves
        if not joined.any():
            return
        rows = rows[spread((ends - counts)[joined], counts[joined])]
        lengths = self.lengths[rows]
        totals = np.add.reduceat(lengths, np.cumsum(counts[joined]) - counts[joined])
        self._add([s for s, j in zip(names, joined.tolist(), strict=True) if j], self.pool[spread(self.starts[rows], lengths)], totals)

    def cut(self, texts: pa.Array | list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(segments of all texts in order, number of segments of each text); a null text has none."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
        parts = [[t] if any(w in t for w in self.whole) else split(t) for t in strings(texts.filter(pa.array(odd)))]
        flat = pa.concat_arrays([lists.flatten(), pa.array(list(chain.from_iterable(parts)), pa.string())]).dictionary_encode()
        counts = np.zeros(len(texts), np.int64)
        counts[~odd], counts[odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False), list(map(len, parts))
        if not odd.any():
            return flat, counts
        order, place = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), np.zeros(len(texts), np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        return flat.take(pa.array(spread(place, counts))), counts

    def learn_all(self, cuts: list[tuple[pa.DictionaryArray, np.ndarray]]) -> None:
        """Every new segment of some blocks, in one go."""
        self.trim()
        new = {s: None for flat, _ in cuts for s in strings(flat.dictionary) if s not in self.rows}
        if new:
            self.learn(pa.array(list(new), pa.string()))

    def gather(self, flat: pa.DictionaryArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text) of a block that was cut."""
        names = strings(flat.dictionary)
        rows = np.fromiter(map(self.rows.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(rows < 0)
        if len(new):
            self.learn(flat.dictionary.take(pa.array(new)))
            rows[new] = [self.rows[names[i]] for i in new.tolist()]
        rows = rows[flat.indices.to_numpy()]
        self.uses[: len(self.rows)] += np.bincount(rows, minlength=len(self.rows))
        lengths, ends = self.lengths[rows], np.cumsum(counts)
        before = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[spread(self.starts[rows], lengths)], before[ends] - before[ends - counts]

    def block(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text); a null text has none."""
        self.trim()
        return self.gather(*self.cut(texts))


class LibraryEncoder(Segments):
    """The tokenizers library's ids, without the special tokens that it would add.

    By default the strings of added tokens in a text are those tokens, as the library has it; with literal=True they are plain text.
    """

    def __init__(self, path: str, literal: bool = False, most_bytes: int = 160_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.model, self.table = self.tokenizer.model, byte_chars()
        self.line = self.table[10]
        super().__init__([] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()], most_bytes)

    def encode_whole(self, segment: str) -> list[int] | None:
        return self.tokenizer.encode(segment, add_special_tokens=False).ids  # rarer characters: the library's own pre-tokeniser decides

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lone = [p for p in pieces if "\n" not in p]
        shown = dict(zip(lone, "\n".join(lone).encode().decode("latin-1").translate(self.table).split(self.line), strict=False))
        shown.update((p, p.encode().decode("latin-1").translate(self.table)) for p in pieces if "\n" in p)
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(shown[p])] for p in pieces]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.block([text])[0].astype("<u4").tobytes()


def library_encoder(path: str, most_bytes: int = 160_000_000) -> LibraryEncoder:
    """One encoder, and so one table, for each worker process and vocabulary file."""
    return held(("segments", path, most_bytes), lambda: LibraryEncoder(path, most_bytes=most_bytes))
