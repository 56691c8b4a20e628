"""Operator 2: a bigram language model with deleted interpolation.

P(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the context's frequency
c(v) (powers of two) and the three weights of a bucket are learned by expectation-maximisation on counts of documents
that were deleted from the training text for that purpose (DELETED below); afterwards they are counted again.

Counting covers every document, and nothing that grows with the text passes through the driver:

1. Tokens of neighbouring documents form blocks of at most BLOCK_TOKENS, written once as small integer codes with the
   block's word hashes. Training, deleted and test documents have blocks of their own.
2. A block asks for its distinct words and distinct bigrams: sorted 64-bit hashes with its own counts, cut by ranges of
   the hash into shards. A hot word or bigram is one entry for each block, so no shard is hot.
3. A shard sums up and answers each block in the block's own order, which makes an answer a list of mostly tiny numbers.
4. Blocks meet their answers: deleted blocks give the histogram for the weights, at most some 50,000 cells summed by
   Spark; then all blocks score their documents.

Cases: null and empty texts are their end token alone; equal doc_ids are scored separately; a null doc_id counts as the
empty string when folds are dealt; without training tokens every word is unknown and the base is log10(1 / (0 + 0 + 1)) = 0;
without deleted documents the weights are DEFAULT; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweft.llm._common import _uncollected, attach, crc_mod, mapped, stored, text_runs
from tokenweft.llm.near_join import _groups, _spans
from tokenweft.llm.words import mix, word_table

FOLDS, TEST, DELETED = 7, 2, 3
BLOCK_TOKENS, SHARD_TOKENS = 3_000_000, 3_000_000
BUCKETS, BINS2, BINS1 = 20, 48, 64
DEFAULT = np.array([0.1, 0.3, 0.6])
END, BEGIN = np.uint64(xxhash.xxh64_intdigest(b" end", 1)), np.uint64(xxhash.xxh64_intdigest(b" begin", 1))


def pack_counts(v: np.ndarray) -> bytes:
    """Counts as a length, one byte each, and four more for each of 255 or over (counts stay below 2**32 in a block or shard answer)."""
    return len(v).to_bytes(8, "little") + np.minimum(v, 255).astype("u1").tobytes() + v[v >= 255].astype("<u8").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, "u1", n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", -1, 8 + n)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes, byte plane by byte plane, so that the equal high bytes compress."""
    return np.ascontiguousarray(keys.astype("<u8").view("u1").reshape(-1, 8).T).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(8, -1).T).view("<u8").ravel()


_BLOCKS = "block long, kind int, n_tokens long, doc_ids array<long>, counts binary, vocabulary binary, codes binary"
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("vocabulary", pa.binary()), ("codes", pa.binary())])


def _make_blocks(most: int):
    def run(batches):
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)
        table = word_table(False)
        held: dict[int, list] = {0: [], 1: [], 2: []}
        size = [0, 0, 0]

        def close(kind: int):
            parts, held[kind], size[kind] = held[kind], [], 0
            counts = np.concatenate([c for _, c, _ in parts])
            vocabulary, codes = np.unique(np.concatenate([h for _, _, h in parts]), return_inverse=True)
            ids = list(itertools.chain.from_iterable(i for i, _, _ in parts))
            row = [next(number), kind, len(codes), ids, counts.astype("<u4").tobytes(), vocabulary.tobytes(), codes.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCKS_ARROW.types, strict=True)], schema=_BLOCKS_ARROW)

        for whole in batches:
            for batch in text_runs(whole):
                kinds = batch.column("kind").to_numpy()
                for kind in np.unique(kinds).tolist():
                    part = batch.filter(pa.array(kinds == kind))
                    table.trim()
                    found = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in part.column("text").to_pylist()]
                    counts = np.array([len(w) + 1 for w in found], np.int64)
                    hashes = np.full(int(counts.sum()), END, np.uint64)
                    inner = np.ones(len(hashes), bool)
                    inner[np.cumsum(counts) - 1] = False
                    hashes[inner] = table.hashes(table.rows([w for ws in found for w in ws]))
                    if size[kind] and size[kind] + len(hashes) > most:
                        yield close(kind)
                    held[kind].append((part.column("doc_id").to_pylist(), counts, hashes))
                    size[kind] += len(hashes)
        for kind in (0, 1, 2):
            if held[kind]:
                yield close(kind)

    return run


class BlockRow:
    """A block decoded: hashes of its words, codes of its tokens, its documents, and its bigrams."""

    def __init__(self, counts: bytes, vocabulary: bytes, codes: bytes):
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.vocabulary, self.codes = np.frombuffer(vocabulary, "<u8"), np.frombuffer(codes, "<u4").astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        before = np.empty(len(self.codes), np.uint64)
        tokens = self.vocabulary[self.codes]
        before[1:] = tokens[:-1]
        before[self.starts] = BEGIN
        self.bigrams, self.bigram_of = np.unique(mix(before, tokens), return_inverse=True)
        # a text begins as often as one ends
        self.context = np.empty(len(self.codes), np.int64)
        self.context[1:] = self.codes[:-1]
        self.context[self.starts] = int(np.searchsorted(self.vocabulary, END))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


def bounds(shards: int) -> np.ndarray:
    """First hash of each shard but the first."""
    return np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)


_ASKED = "shard int, block long, kind int, words binary, word_counts binary, pairs binary, pair_counts binary"


def _ask(shards: int):
    limits = bounds(shards)

    def run(batches):
        for batch in batches:
            for block, kind, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "counts", "vocabulary", "codes")), strict=True):
                b = BlockRow(*row)
                columns = []
                for keys, counts in ((b.vocabulary, np.bincount(b.codes)), (b.bigrams, np.bincount(b.bigram_of))):
                    edges = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
                    columns += [[pack_keys(keys[s:e]) for s, e in zip(edges, edges[1:], strict=False)], [pack_counts(counts[s:e]) for s, e in zip(edges, edges[1:], strict=False)]]
                some = [i for i in range(shards) if columns[0][i] or columns[2][i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([kind] * len(some), pa.int32()), *(pa.array([c[i] for i in some], pa.binary()) for c in columns)],
                    names=["shard", "block", "kind", "words", "word_counts", "pairs", "pair_counts"],
                )

    return run


_ANSWERED = "block long, shard int, words_kept binary, words_deleted binary, pairs_kept binary, pairs_deleted binary, stats array<long>"


def _answer(batches):
    """For each block of a shard the corpus counts of what it asked for; and the shard's own totals, once, as block -1."""
    for table in _groups(batches, "shard"):
        shard = table.column("shard").to_numpy()
        rows = table.to_pylist()
        for s, e in _spans(shard):
            group = rows[s:e]
            answers, stats = [], []
            for keys_name, counts_name in (("words", "word_counts"), ("pairs", "pair_counts")):
                keys = [unpack_keys(r[keys_name]) for r in group]
                sizes = [len(k) for k in keys]
                _, at = np.unique(np.concatenate(keys), return_inverse=True)
                counts = np.concatenate([unpack_counts(r[counts_name]) for r in group]).astype(float)
                kind = np.repeat([r["kind"] for r in group], sizes)
                n = int(at.max()) + 1 if len(at) else 0
                kept = np.bincount(at, weights=counts * (kind == 0), minlength=n).astype(np.int64)
                deleted = np.bincount(at, weights=counts * (kind == 1), minlength=n).astype(np.int64)
                edges = np.cumsum([0, *sizes])
                answers.append([(pack_counts(kept[at[a:b]]), pack_counts(deleted[at[a:b]])) for a, b in zip(edges[:-1], edges[1:], strict=True)])
                stats += [int(kept.sum()), int((kept + deleted).sum()), int((kept > 0).sum()), int((kept + deleted > 0).sum())]
            out = [(r["block"], int(shard[s]), *w, *p, None) for r, w, p in zip(group, *answers, strict=True)]
            out.append((-1, int(shard[s]), b"", b"", b"", b"", stats))
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            names = ["block", "shard", "words_kept", "words_deleted", "pairs_kept", "pairs_deleted", "stats"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _met(block: pa.Table, answers: pa.Table) -> tuple[BlockRow, list[np.ndarray]]:
    """A block with (words kept, words deleted, pairs kept, pairs deleted), in the order of its words and bigrams."""
    row = BlockRow(*(block.column(c)[0].as_py() for c in ("counts", "vocabulary", "codes")))
    order = np.argsort(answers.column("shard").to_numpy())
    found = []
    for c in ("words_kept", "words_deleted", "pairs_kept", "pairs_deleted"):
        data = answers.column(c).to_pylist()
        found.append(np.concatenate([unpack_counts(data[i]) for i in order]))
    return row, found


def frequency_bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole logarithm to base 2; the last bucket is open."""
    return np.minimum(np.ceil(np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)


def _histogram(total: int, distinct: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        b, (words, _, pairs, _) = _met(block, answers)
        context = words[b.context]
        f2 = np.where(context > 0, pairs[b.bigram_of] / np.maximum(context, 1), 0.0)
        f1 = words[b.codes] / max(total, 1)
        with np.errstate(divide="ignore"):
            q2 = np.where(f2 > 0, np.minimum(1 - 2 * np.log2(f2), BINS2 - 1), 0).astype(np.int64)
            q1 = np.where(f1 > 0, np.minimum(1 - 2 * np.log2(f1), BINS1 - 1), 0).astype(np.int64)
        cell = (frequency_bucket(context) * BINS2 + q2) * BINS1 + q1
        at, inverse, n = np.unique(cell, return_inverse=True, return_counts=True)
        return pa.table({"cell": at, "n": n, "s2": np.bincount(inverse, weights=f2), "s1": np.bincount(inverse, weights=f1)})

    return run


def mixture(cells: np.ndarray, n: np.ndarray, f2: np.ndarray, f1: np.ndarray, f0: float, rounds: int = 60) -> np.ndarray:
    """(BUCKETS, 3): the weights of uniform, unigram and bigram estimates for each bucket, by expectation-maximisation."""
    bucket = cells // (BINS2 * BINS1)
    features = np.stack([np.full(len(cells), f0), f1, f2], axis=1)

    def em(mine: np.ndarray, start: np.ndarray) -> np.ndarray:
        weights = start.copy()
        for _ in range(rounds):
            share = features[mine] * weights
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            weights = (share * n[mine, None]).sum(0)
            weights = np.maximum(weights / weights.sum(), 1e-6)
            weights /= weights.sum()
        return weights

    if not len(cells):
        return np.tile(DEFAULT, (BUCKETS, 1))
    pooled = em(np.ones(len(cells), bool), DEFAULT)
    out = np.tile(pooled, (BUCKETS, 1))
    for k in range(BUCKETS):
        if (bucket == k).any():
            out[k] = em(bucket == k, pooled)
    out[0] = [*(out[0][:2] / out[0][:2].sum()), 0.0]  # an unseen context has no bigram estimate
    return out


_SCORED = "doc_id long, kind int, n_tokens long, n_known long, base_score double, score double"


def _score(total: int, distinct: int, weights: np.ndarray):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        b, (words, words_deleted, pairs, pairs_deleted) = _met(block, answers)
        words, pairs = words + words_deleted, pairs + pairs_deleted
        own, context = words[b.codes], words[b.context]
        base = np.log10((own + 1.0) / (total + distinct + 1))
        f2 = np.where(context > 0, pairs[b.bigram_of] / np.maximum(context, 1), 0.0)
        w = weights[frequency_bucket(context)]
        p = w[:, 0] / (distinct + 1) + w[:, 1] * own / max(total, 1) + w[:, 2] * f2
        ids = block.column("doc_ids")[0].as_py()
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "kind": pa.array([block.column("kind")[0].as_py()] * len(ids), pa.int32()), "n_tokens": b.counts,
            "n_known": b.sums((own > 0).astype(np.int64)), "base_score": b.sums(base), "score": b.sums(np.log10(p)),
        })

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    attach(docs.sparkSession)
    fold = crc_mod(F.col("doc_id"), FOLDS)
    kind = F.when(fold == TEST, 2).when(fold == DELETED, 1).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("kind", kind)
    blocks = stored(mapped(rows, _make_blocks(BLOCK_TOKENS), _BLOCKS))
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-tokens // SHARD_TOKENS))
    asked = mapped(blocks.select("block", "kind", "counts", "vocabulary", "codes"), _ask(shards), _ASKED)
    answers = stored(mapped(asked.repartition(shards, "shard").sortWithinPartitions("shard"), _answer, _ANSWERED))
    stats = answers.where("block = -1").select(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(4))).first()
    kept_total, total, kept_distinct, distinct = (int(x or 0) for x in stats)
    answered = answers.where("block >= 0").drop("stats")

    def meet(some: DataFrame, f, schema: str) -> DataFrame:
        return some.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_paired(f, schema), schema)

    deleted = blocks.where("kind = 1")
    cells = meet(deleted, _histogram(kept_total, kept_distinct), "cell long, n long, s2 double, s1 double")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).toPandas()  # at most BUCKETS * BINS2 * BINS1 rows
    n = cells["n"].to_numpy(float)
    weights = mixture(cells["cell"].to_numpy(np.int64), n, cells["s2"].to_numpy(float) / np.maximum(n, 1), cells["s1"].to_numpy(float) / np.maximum(n, 1), 1.0 / (kept_distinct + 1))
    scored = meet(blocks, _score(total, distinct, weights), _SCORED)
    return scored.select("doc_id", (F.col("kind") == 2).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _paired(f, schema: str):
    """f for a block and its answers; answers of blocks that are not asked about give nothing."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    empty = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")]).empty_table()

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return empty
        return next(iter(_uncollected(lambda _: iter([f(block, answers)]))(None)))

    return run
