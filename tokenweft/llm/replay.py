"""Operator 10: byte-level BPE by corpus-level merge replay, and decoding.

All distinct new pieces of a batch of texts are laid out as one list of byte tokens. An inverted index maps the
pairs that can merge, by rank and in blocks of SPAN ranks, to their positions. Blocks are applied in rank order; inside
a block every word applies its lowest pair first, at all its places from the left (at the first only, where a pair that
the merge makes may rank before it), and the pairs on the two sides of a merge are all that is looked up again. No word
waits for another, so this is exactly the order in which a word-by-word encoder works, for all words at once. Pieces met
before come from a bounded table.

Cases: a null or empty text has no ids (the digests of the empty string); ids of rows with equal doc_id stay
separate; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweft.llm._common import held, mapped, text_runs
from tokenweft.llm.segments import Segments, spread

#: Ranks in a block of the inverted index.
SPAN = 1024


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class MergeReplay:
    """ranks: token bytes -> rank, as in a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.size = max(ranks.values(), default=0) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.merged = np.append(keys, np.int64(-1)), np.array([pairs[k] for k in keys.tolist()] + [-1], np.int64)
        self.keys[-1] = np.iinfo(np.int64).max
        # of most tokens every further merge ranks behind the token itself; of the others one may come before
        self.early = np.zeros(self.size, bool)
        for part in (keys // self.size, keys % self.size):
            self.early[part[self.merged[:-1] < part]] = True
        self.singles = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    @classmethod
    def from_file(cls, path: str) -> MergeReplay:
        with open(path, "rb") as lines:  # a local vocabulary file on every worker, as a parameter
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of merged pairs, -1 where a pair doesn't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        ids, lengths = self.encode_all(pieces)
        return np.split(ids, np.cumsum(lengths)[:-1]) if pieces else []

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each. A piece that is a token is that token, whatever the merges would give."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        todo = np.flatnonzero(whole < 0)
        ids, lengths = self._replay([pieces[i] for i in todo.tolist()])
        out = (whole >= 0).astype(np.int64)
        out[todo] = lengths
        flat = np.empty(int(out.sum()), np.int64)
        starts = np.cumsum(out) - out
        known = whole >= 0
        flat[starts[known]] = whole[known]
        flat[spread(starts[todo], lengths)] = ids
        return flat, out

    def _replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.singles[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        if not n:
            return ids, sizes
        word = np.append(np.repeat(np.arange(len(pieces)), sizes), -1)  # at n: no word, so no pair reaches over the end
        after, before = np.append(np.arange(1, n + 1), n), np.arange(-1, n)
        pair = np.full(n + 1, -1, np.int64)  # rank of the pair that begins at a position
        inside = word[:-2] == word[1:-1]
        pair[: n - 1][inside] = self.rank_of(ids[:-1][inside], ids[1:][inside])
        index: list[list[np.ndarray]] = [[] for _ in range(self.size // SPAN + 1)]

        def add(places: np.ndarray) -> None:
            if not len(places):
                return
            block = pair[places] // SPAN
            order = np.argsort(block, kind="stable")
            places, block = places[order], block[order]
            edges = np.flatnonzero(np.diff(block, prepend=-2)).tolist()
            for a, b in zip(edges, [*edges[1:], len(places)], strict=True):
                index[block[a]].append(places[a:b])

        add(np.flatnonzero(pair >= 0))
        for block in range(len(index)):
            top = (block + 1) * SPAN
            places = np.concatenate(index[block]) if index[block] else np.empty(0, np.int64)
            index[block] = []
            while len(places):
                places = distinct(places)
                ranks = pair[places]
                live = (ranks >= 0) & (ranks < top)
                places, ranks = places[live], ranks[live]
                if not len(places):
                    break
                words = word[places]
                edges = np.flatnonzero(np.diff(words, prepend=-1))
                least = np.repeat(np.minimum.reduceat(ranks, edges), np.diff(np.append(edges, len(places))))
                at = np.flatnonzero(ranks == least)  # in every word the places of its lowest pair
                # of places that overlap each second one; all go at once unless a pair that a merge makes may rank before it
                heads = np.append(True, words[at[1:]] != words[at[:-1]])
                follows = np.append(False, after[places[at[:-1]]] == places[at[1:]])
                first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[heads | (~self.early[ranks[at]] & ((np.arange(len(at)) - first) % 2 == 0))]
                waiting = np.ones(len(places), bool)
                waiting[at] = False
                waiting, places, ranks = places[waiting], places[at], ranks[at]
                gone = after[places]
                ids[places], ids[gone], pair[gone] = ranks, -1, -1
                follow = after[gone]
                after[places], before[follow] = follow, places
                # after all merges of the round: the pairs on both sides of each
                right = after[places]
                near = word[right] == word[places]
                pair[places] = -1
                pair[places[near]] = self.rank_of(ids[places[near]], ids[right[near]])
                prior = before[places]
                prior = prior[(prior >= 0) & (word[prior] == word[places])]
                pair[prior] = self.rank_of(ids[prior], ids[after[prior]])
                touched = distinct(np.concatenate([places, prior]))
                now = pair[touched]
                add(touched[now >= top])
                places = np.concatenate([waiting, touched[(now >= 0) & (now < top)]])
        live = ids >= 0
        return ids[live], np.bincount(word[:-1][live], minlength=len(pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class ReplayEncoder(Segments):
    """Encodes blocks of texts; all pieces that are new in a batch are replayed together."""

    def __init__(self, path: str, most_bytes: int = 160_000_000):
        self.replay = MergeReplay.from_file(path)
        super().__init__(most_bytes=most_bytes)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.replay.encode_all([p.encode() for p in pieces])

    def batches(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of a batch of texts with their ids and numbers of ids; the batch's new segments are learned at once."""
        parts = list(text_runs(batch, limit=2_000_000))
        cuts = [self.cut(p.column("text")) for p in parts]
        self.learn_all(cuts)
        for part, c in zip(parts, cuts, strict=True):
            yield part, *self.gather(*c)


class Strings:
    """A byte string for each id, joined for many ids at once."""

    def __init__(self, values: list[bytes]):
        self.lengths = np.fromiter(map(len, values), np.int64, len(values))
        self.starts, self.pool = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(values), np.uint8)

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """For each run of `counts` ids its joined strings."""
        lengths = self.lengths[ids]
        data = self.pool[spread(self.starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)].tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _encoder(path: str) -> ReplayEncoder:
    return held(("replay", path), lambda: ReplayEncoder(path))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    def run(batches):
        encoder = _encoder(path)
        tokens = encoder.replay.tokens
        decimal, decoded = Strings([b"%d," % i for i in range(encoder.replay.size)]), Strings([tokens.get(i, b"") for i in range(encoder.replay.size)])
        for whole in batches:
            for batch, ids, counts in encoder.batches(whole):
                ids_sha = [hashlib.sha256(d[:-1]).hexdigest() for d in decimal.join(ids, counts)]
                text_sha = [hashlib.sha256(d).hexdigest() for d in decoded.join(ids, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=_OUT)

    return run


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes they decode to."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, _digests(ranks_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the ids themselves."""

    def run(batches):
        encoder = _encoder(ranks_path)
        for whole in batches:
            for batch, ids, counts in encoder.batches(whole):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], schema=_IDS)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the text that the ids stand for; bytes that are no UTF-8 become U+FFFD. Null ids give a null text."""

    def run(batches):
        replay = _encoder(ranks_path).replay
        for batch in batches:
            texts = [None if ids is None else replay.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return mapped(coded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string")
