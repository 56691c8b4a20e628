"""Packing, the store and merge replay against the libraries themselves."""

import base64
import bisect
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tokenweft.llm import packing, replay, segments, store

LIBRARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(LIBRARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODER, REPLAY = segments.LibraryEncoder(LIBRARY), replay.ReplayEncoder(RANKS)
TEXTS = st.text(alphabet=st.sampled_from("aAbZé'sdlre1².,!# \n\t\r\x0b\x1c\x1f\x85\xa0  　中文🙂Жʰ́​<|>"), max_size=40) | st.text(max_size=30)
TEXTS |= st.lists(st.sampled_from(["<|endoftext|>", "a", " b", " ", "  ", "\n", "<|", "é", "中", "\t"]), max_size=8).map("".join)


def test_pattern_is_the_public_one():
    assert segments.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_segments_encode_as_whole_texts(library, text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == library(text)


def test_added_tokens_as_plain_text():
    t = Tokenizer.from_file(LIBRARY)
    t.encode_special_tokens = True
    literal = segments.LibraryEncoder(LIBRARY, literal=True)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n\ny"):
        assert np.frombuffer(literal.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS | st.none(), max_size=6))
def test_blocks_encode_as_lone_texts(library, texts):
    ids, counts = segments.LibraryEncoder(LIBRARY).block(texts) if len(texts) > 4 else ENCODER.block(texts)
    assert ids.tolist() == [i for t in texts for i in library(t)] and counts.tolist() == [len(library(t)) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_replay_is_word_by_word_encoding(reference, texts):
    ids, counts = REPLAY.block(texts)
    assert ids.tolist() == [i for t in texts for i in reference.encode_ordinary(t)] and counts.tolist() == [len(reference.encode_ordinary(t)) for t in texts]


def test_replay_of_long_words(reference):
    rng = np.random.default_rng(3)
    words = ["x" * 3_000, "ab" * 1_500, "".join(rng.choice(list("aeiourst"), 4_000)), *("".join(rng.choice(list("abcdeé中"), n)) for n in range(1, 400))]
    assert REPLAY.block(words)[0].tolist() == [i for w in words for i in reference.encode_ordinary(w)]
    ids, _ = REPLAY.block(["x" * 2_000_000])  # the library's time grows with the square of such a word
    assert REPLAY.replay.decode(ids.tolist()) == b"x" * 2_000_000 and len(ids) == 1_000_000


def test_replay_follows_ranks_that_fall_after_a_merge():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 400, b"abc": 350, b"aa": 500, b"aab": 260}
    own = replay.MergeReplay(ranks)
    enc = tiktoken.Encoding("tiny", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for word in ("abc", "aabc", "aaaab", "abab", "caabcaab", "aaa", "aaaaaab"):
        assert own.encode_pieces([word.encode()])[0].tolist() == enc.encode_ordinary(word)


def test_round_trip_query(docs, rows, nothing, reference):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in replay.round_trip(docs, RANKS).collect())
    want = []
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want) and replay.round_trip(nothing, RANKS).count() == 0
    back = replay.decode(replay.encode(docs.where("doc_id = 84"), RANKS), RANKS).first()["text"]
    assert back == next(t for i, t, _ in rows if i == 84)


def test_store_returns_the_streams(spark, docs, rows, nothing, library, tmp_path):
    path = str(tmp_path / "store")
    got = store.stored_digest(docs, LIBRARY, path, average=16, longest=64).collect()
    want = sorted(((-1 if i is None else i), zlib.crc32(np.array([*library(t), 2], "<u4").tobytes()), len(library(t)) + 1) for i, t, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got) == want
    place = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == place
        place += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)
    whole = {r["start"]: r["ids"] for r in store.reconstruct(spark, path).collect()}
    assert {s: zlib.crc32(np.array(x, "<u4").tobytes()) for s, x in whole.items()} == {r["start"]: r["ids_crc32"] for r in got}
    chunks = spark.read.parquet(f"{path}/parts").where("kind = 1")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert store.stored_digest(nothing, LIBRARY, str(tmp_path / "empty")).count() == 0


def test_store_notices_a_changed_chunk():
    ids = np.arange(10, dtype="<u4")
    import pyarrow as pa

    good = {"key": [store.digest(ids.tobytes())], "width": [2], "n_ids": [10], "payload": [ids.astype("<u2").tobytes()]}
    assert len(list(store._checked([pa.RecordBatch.from_pydict(good)]))) == 1
    with pytest.raises(ValueError, match="digest"):
        list(store._checked([pa.RecordBatch.from_pydict(good | {"payload": [bytes(20)]})]))


def test_manifest_is_a_tree_over_recipes_in_order(spark, docs, tmp_path):
    """Any change of a recipe, of its place or of a length is noticed before anything is returned."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "store")
    store.write_store(docs.where("doc_id < 30"), path, LIBRARY, average=16, longest=64)
    kept = {r["bucket"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    recipes = spark.read.parquet(f"{path}/recipes")
    rows = sorted(recipes.collect(), key=lambda r: (r["bucket"], r["row"]))
    leaves = [store.digest(b"%d|%d|%d|" % (r["doc_id"], r["place"], r["n_tokens"]) + bytes(r["root"])) for r in rows]
    level = leaves
    while len(level) > 1:
        level = [store.digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert bytes(kept[0]["root"]) == level[0] and kept[0]["n_docs"] == len(rows) == kept[-1]["n_docs"]
    swapped = F.concat(F.expr("substring(links, 1, length(links) - 8)"), F.expr("substring(links, length(links) - 3, 4)"), F.expr("substring(links, length(links) - 7, 4)"))
    for name, changed in (("id", recipes.withColumn("doc_id", F.col("doc_id") + 1)), ("place", recipes.withColumn("place", F.col("place") + 1)), ("lengths", recipes.withColumn("links", swapped))):
        other = str(tmp_path / name)
        spark.read.parquet(f"{path}/parts").write.parquet(f"{other}/parts")
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{other}/manifest")
        changed.write.parquet(f"{other}/recipes")
        with pytest.raises(Exception, match="match|too long"):
            store.read_store(spark, other).collect()


def test_chunks_follow_content_and_stop_at_document_ends():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 50_000, 3000).astype("<u4")
    a, b = np.concatenate([rng.integers(0, 50_000, 100), shared]).astype("<u4"), np.concatenate([rng.integers(0, 50_000, 333), shared]).astype("<u4")
    ends = store.cut_points(np.concatenate([a, b]), np.array([0, len(a)]), 64, 1000)
    assert len(a) in ends and ends[-1] == len(a) + len(b) and np.diff(ends, prepend=0).max() <= 1000
    parts = [set(), set()]
    last = 0
    both = np.concatenate([a, b])
    for e in ends:
        parts[int(e > len(a))].add(both[last:e].tobytes())
        last = e
    assert len(parts[0] & parts[1]) > 0.8 * len(parts[0])
    assert np.array_equal(store.cut_points(a, np.array([0]), 64, 1000), ends[ends <= len(a)])


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_crc_of_joined_bytes(a, b):
    shifted = store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))
    assert int(shifted[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def check_packing(got, rows, library, capacity):
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t, _ in rows:
        if i is None or i == 10:  # equal ids: only the sums can be told
            continue
        ids = [*library(t), 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert all(r["length"] == capacity for r in pieces[1:])
        for r in pieces:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    return by_seq


def test_packing(docs, rows, nothing, library):
    for capacity, small in ((2048, 256), (128, 16)):
        got = packing.pack(docs, LIBRARY, capacity, small=small, groups=8).collect()
        sequences = check_packing(got, rows, library, capacity)
        total = sum(len(library(t)) + 1 for _, t, _ in rows)
        assert sum(r["length"] for r in got) == total and len(sequences) <= 1.1 * total / capacity + 2
    assert packing.pack(nothing, LIBRARY).count() == 0


def best_fit(sizes, capacity):
    """Sequences of best-fit decreasing, piece by piece."""
    rooms, n = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            room, n = capacity, n + 1
        else:
            room = rooms.pop(at)
        if room > size:
            bisect.insort(rooms, room - size)
    return n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 400)), max_size=25))
def test_plans_place_every_piece_once(pieces):
    counts = np.zeros(65, np.int64)
    for size, n in pieces:
        counts[size] += n
    found, sequences = packing.plan(counts, 64, 8, 6)
    room, placed = np.zeros(sequences, int), np.zeros(65, int)
    spans = {}
    for size, first, number, sequence, offset in found:
        spans.setdefault(size, []).append((first, number))
        placed[size] += number
        for k in range(number):
            assert room[sequence + k] == offset
            room[sequence + k] += size
    assert (placed == counts).all() and (room <= 64).all() and (room > 0).all()
    for s in spans.values():
        at = 0
        for first, number in sorted(s):
            assert first == at
            at += number
    assert sequences <= best_fit(np.repeat(np.arange(65), counts).tolist(), 64)


def test_plans_are_no_longer_than_best_fit():
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 2049, 4000), rng.integers(600, 1100, 4000), np.minimum(2048, rng.lognormal(6, 1, 4000).astype(int) + 1)):
        assert packing.plan(np.bincount(sizes, minlength=2049))[1] <= best_fit(sizes.tolist(), 2048)


def test_recipes_are_read_without_payloads(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(docs.where("doc_id < 30"), path, LIBRARY, average=16, longest=64)
    parts = spark.read.parquet(f"{path}/parts")
    assert parts.where("kind = 0 and (payload is not null or links is null)").isEmpty()
    assert parts.where("kind = 1 and (payload is null or links is not null)").isEmpty()


def test_checked_chunks_of_both_widths():
    import pyarrow as pa

    streams = [np.arange(5, 5 + n, dtype="<u4") for n in (3, 1, 8)] + [np.array([70_000, 1], "<u4")]
    widths = [2, 4, 2, 4]
    rows = {"key": [store.digest(x.tobytes()) for x in streams], "width": widths, "n_ids": [len(x) for x in streams], "payload": [x.astype(f"<u{w}").tobytes() for x, w in zip(streams, widths, strict=True)]}
    batch = pa.RecordBatch.from_pydict(rows)
    found = {r["digest"]: (r["n"], r["crc"]) for b in store._checked([batch, batch.slice(1, 2), batch.slice(0, 0)]) for r in b.to_pylist()}
    assert found == {store.digest(x.tobytes()): (len(x), zlib.crc32(x.tobytes())) for x in streams}
    for odd in ({"n_ids": [3, 1, 7, 2]}, {"width": [2, 4, 8, 4]}, {"payload": [b"", *rows["payload"][1:]]}):
        with pytest.raises(ValueError):
            list(store._checked([pa.RecordBatch.from_pydict(rows | odd)]))


def test_crc_shift_over_long_tails():
    crc = np.array([zlib.crc32(b"head"), 0, zlib.crc32(b"x")])
    tails = [bytes(1 << 20), b"abc", bytes(range(256)) * 5000]
    shifted = store.crc_shift(crc, np.array([len(t) for t in tails]))
    assert [int(a) ^ zlib.crc32(t) for a, t in zip(shifted, tails, strict=True)] == [zlib.crc32(h + t) if h else zlib.crc32(t) for h, t in zip((b"head", b"", b"x"), tails, strict=True)]
