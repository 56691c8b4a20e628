"""Operator 8: a content-addressed store of token-id streams.

A rolling hash over the last WINDOW ids cuts every document's stream where its low bits are zero, so equal
passages give equal chunks wherever they stand. Unique chunks are written once under their digest. A recipe for
each document lists its chunk digests with their lengths and has their Merkle root. Recipes lie in ascending doc_id
order in buckets, and a manifest has for each bucket its place in the whole stream and the Merkle root over its
documents in order, each of which stands for its doc_id, place, length and recipe root; the bucket roots have a root too.
Reading checks every chunk against its digest, every recipe against its root, every link's length against its chunk's,
and all of it against the manifest before anything is returned.

Layout below the store's folder: parts/ (chunks: digest, width, n_ids, payload; and recipes, their links in a column of
their own, before they are placed, so that reading recipes leaves the payloads alone), recipes/, manifest/. Ids are little-endian, two bytes wide where all ids of a chunk fit, else four.

Cases: a null text is an empty one and still gets its end id; null doc_ids come first; equal doc_ids are kept
as separate rows, ordered by content; an empty table gives empty files and an empty result; other columns of
the input are never read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweft.llm._common import mapped, shared_dir, stored, text_runs
from tokenweft.llm.segments import ended, library_encoder

WINDOW = 8
DIGEST = 16
#: Documents in a bucket of recipes, and the most buckets; a bucket's digests (16 bytes a document) meet in one task.
BUCKET_ROWS, MOST_BUCKETS = 4_000, 16_384
_MULTIPLIER = np.uint32(0x9E3779B1)


def cut_points(ids: np.ndarray, starts: np.ndarray, average: int, longest: int) -> np.ndarray:
    """Ends of the chunks of streams that lie end to end and begin at `starts`, every stream's own end included.

    A chunk ends after an id where the hash of the last WINDOW ids of its stream has log2(average) zero bits, and
    after `longest` ids.
    """
    n = len(ids)
    mixed = ids * _MULTIPLIER
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA6B)
    rolled = mixed.copy()
    for back in range(1, min(WINDOW, n)):
        rolled[back:] += mixed[: n - back] << np.uint32(3 * back)
    rolled *= _MULTIPLIER
    ends = np.flatnonzero((rolled >> np.uint32(12)) & np.uint32(average - 1) == 0) + 1
    stream = np.searchsorted(starts, ends - 1, "right") - 1
    ends = ends[ends - starts[stream] >= WINDOW]  # the window must lie in the stream
    ends = np.union1d(ends, np.append(starts[1:], n))
    sizes = np.diff(ends, prepend=0)
    if (sizes > longest).any():
        more = [np.arange(e - s + longest, e, longest) for e, s in zip(ends[sizes > longest].tolist(), sizes[sizes > longest].tolist(), strict=True)]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree over the digests; an odd one moves up as it is; none gives the digest of nothing."""
    level = list(digests) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def unpack(width: int, payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{width}").astype("<u4")


_PARTS = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("root", pa.binary()), ("width", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("links", pa.binary())])
_PARTS_SQL = "kind int, key binary, doc_id long, root binary, width int, n_ids long, payload binary, links binary"


def _part_rows(n: int, **columns) -> pa.RecordBatch:
    """n rows of _PARTS; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _PARTS], schema=_PARTS)


def _parts(path: str, end_id: int, average: int, longest: int):
    """kind 0: a recipe (key: its place among the task's rows, links: chunk digests, then lengths); kind 1: a chunk of a block (key: its digest)."""

    def run(batches):
        from pyspark import TaskContext

        encoder, part, at = library_encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in text_runs(whole, limit=3_000_000):
                ids, sizes = ended(*encoder.block(batch.column("text")), end_id)
                starts = np.cumsum(sizes) - sizes
                data = memoryview(ids).cast("B")
                ends = cut_points(ids, starts, average, longest)
                lengths = np.diff(ends, prepend=0)
                digests = [digest(data[b:e]) for b, e in zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True)]
                width = 2 if int(ids.max()) < 1 << 16 else 4
                once = dict(zip(digests, range(len(digests)), strict=True))
                at_once = np.fromiter(once.values(), np.int64, len(once))
                payloads = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends) * width), pa.py_buffer(ids.astype(f"<u{width}"))])
                n = len(once)
                yield _part_rows(
                    n,
                    kind=pa.array(np.ones(n, np.int32)),
                    key=pa.array(once, pa.binary()),
                    width=pa.array(np.full(n, width, np.int32)),
                    n_ids=pa.array(lengths[at_once]),
                    payload=payloads.take(pa.array(at_once)).cast(pa.binary()),
                )
                joined, last, roots, links = lengths.astype("<u4"), 0, [], []
                for to in np.searchsorted(ends, starts + sizes, "right").tolist():
                    own = digests[last:to]
                    roots.append(merkle(own))
                    links.append(b"".join(own) + joined[last:to].tobytes())
                    last = to
                n = len(roots)
                yield _part_rows(
                    n,
                    kind=pa.array(np.zeros(n, np.int32)),
                    key=pa.array([b"%d:%d" % (part, i) for i in range(at, at + n)], pa.binary()),
                    doc_id=batch.column("doc_id"),
                    root=pa.array(roots, pa.binary()),
                    width=pa.array(np.zeros(n, np.int32)),
                    n_ids=pa.array(sizes),
                    links=pa.array(links, pa.binary()),
                )
                at += n

    return run


_PLACED = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("links", pa.binary())])
_PLACED_SQL = "bucket int, row long, doc_id long, place long, n_tokens long, root binary, links binary"


def _place(batches):
    """The recipes of a sorted partition, which is a bucket, with each one's number and place in it."""
    from pyspark import TaskContext

    bucket, row, place = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ends = place + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), bucket, np.int32)), pa.array(np.arange(row, row + len(n))), batch.column("doc_id"), pa.array(ends - n), *(batch.column(c) for c in ("n_tokens", "root", "links"))],
            schema=_PLACED,
        )
        if len(n):
            row, place = row + len(n), int(ends[-1])


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, average: int = 512, longest: int = 8192) -> None:
    """Encode every text (then end_id) and write chunks, recipes in ascending doc_id order, and the manifest below path."""
    spark = docs.sparkSession
    parts = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _parts(tokenizer_path, end_id, average, longest), _PARTS_SQL)
    # a chunk that a third of all documents share comes once from each block; recipes have keys of their own
    parts.repartition("key").dropDuplicates(["key"]).write.option("compression", "zstd").parquet(f"{path}/parts")

    rough = _read_parts(spark, path, 0).select("doc_id", "root", F.col("n_ids").alias("n_tokens"), "links")
    order = [F.col("doc_id").asc_nulls_first(), F.col("root"), F.xxhash64("links")]
    buckets = min(MOST_BUCKETS, rough.count() // BUCKET_ROWS + 1)
    # equal and null doc_ids are parted by their roots, so that no bucket is hot for them
    dealt = rough.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
    mapped(dealt, _place, _PLACED_SQL).write.option("compression", "zstd").parquet(f"{path}/recipes")
    buckets = manifest_of(_recipes(spark, path))
    spark.createDataFrame(buckets, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def _read_parts(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema(_PARTS_SQL).parquet(f"{path}/parts").where(F.col("kind") == kind)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_PLACED_SQL).parquet(f"{path}/recipes")


_MANIFEST = "bucket int, n_docs long, n_ids long, first long, root binary"
_LEAVES = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("leaf", pa.binary())])


def _leaves(batches):
    """What stands for a document in its bucket's tree: its id, place, length and recipe root."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "place", "n_tokens", "root"))
        leaf = [digest(b"%s|%d|%d|" % (b"" if i is None else b"%d" % i, at, n) + root) for i, at, n, root in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "row", "n_tokens")), pa.array(leaf, pa.binary())], schema=_LEAVES)


def _roots(batches):
    for batch in batches:
        roots = [merkle(list(x)) for x in batch.column("leaves").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "n_docs", "n_ids")), pa.array(roots, pa.binary())], names=["bucket", "n_docs", "n_ids", "root"])


def manifest_of(recipes: DataFrame) -> list[tuple]:
    """(bucket, n_docs, n_ids, first, root) in order, at most MOST_BUCKETS of them, and behind them one for the whole store as bucket -1."""
    leaves = mapped(recipes.select("bucket", "row", "doc_id", "place", "n_tokens", "root"), _leaves, "bucket int, row long, n_tokens long, leaf binary")
    grouped = leaves.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("row", "leaf"))).alias("leaves"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    grouped = grouped.select("bucket", "n_docs", "n_ids", F.transform("leaves", lambda x: x["leaf"]).alias("leaves"))
    out, first = [], 0
    for r in sorted(mapped(grouped, _roots, "bucket int, n_docs long, n_ids long, root binary").collect()):
        out.append((r["bucket"], r["n_docs"], r["n_ids"], first, bytes(r["root"])))
        first += r["n_ids"]
    return [*out, (-1, sum(r[1] for r in out), first, 0, merkle([digest(b"%d|%d|" % (r[0], r[3]) + r[4]) for r in out]))]


_POLY = np.uint64(0xEDB88320)  # fixed value: the reflected polynomial of crc32


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of reflected polynomials modulo crc32's, element by element."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(len(a), np.uint64)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ _POLY, b >> np.uint64(1))
    return out


_shifts: list[tuple[np.ndarray, np.ndarray]] = []


def _shift_tables(k: int) -> np.ndarray:
    """What each byte of a crc32 value, the lowest first, becomes once 2**k more bytes follow."""
    while len(_shifts) <= k:
        power = _times(_shifts[-1][0], _shifts[-1][0]) if _shifts else np.array([1 << 23], np.uint64)  # x to the power 8, reflected
        values = (np.arange(256, dtype=np.uint64) << np.arange(0, 32, 8, dtype=np.uint64)[:, None]).ravel()
        _shifts.append((power, _times(values, np.repeat(power, len(values))).reshape(4, 256)))
    return _shifts[k][1]


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 values as they count once n_bytes more bytes follow: crc32(a + b) = crc_shift(crc32(a), len(b)) ^ crc32(b)."""
    crc, left, k = crc.astype(np.uint64), n_bytes.astype(np.uint64).copy(), 0
    while left.any():
        odd = np.flatnonzero(left & np.uint64(1))
        old, tables = crc[odd].astype(np.int64), _shift_tables(k)
        crc[odd] = tables[0][old & 255] ^ tables[1][old >> 8 & 255] ^ tables[2][old >> 16 & 255] ^ tables[3][old >> 24]
        left, k = left >> np.uint64(1), k + 1
    return crc


_CHECKED = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])


def _checked(batches):
    """(digest, n, crc32) of each chunk; the payloads of a batch are widened together."""
    for batch in batches:
        widths = batch.column("width").to_numpy(zero_copy_only=False)
        for width in np.unique(widths).tolist():
            own = batch.filter(pa.array(widths == width))
            payloads = own.column("payload").cast(pa.large_binary())
            bounds = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1]
            keys, n = own.column("key").to_pylist(), own.column("n_ids").to_numpy()
            wrong = np.diff(bounds) != width * n
            if width not in (2, 4) or wrong.any():
                raise ValueError(f"chunk {keys[int(np.argmax(wrong))].hex()} does not match its digest")
            data = memoryview(np.frombuffer(payloads.buffers()[2], f"<u{width}", int(n.sum()), int(bounds[0])).astype("<u4")).cast("B")
            ends, crcs = 4 * np.cumsum(n), []
            for d, b, e in zip(keys, (ends - 4 * n).tolist(), ends.tolist(), strict=True):
                if digest(data[b:e]) != d:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
                crcs.append(zlib.crc32(data[b:e]))
            yield pa.RecordBatch.from_arrays([own.column("key"), pa.array(n), pa.array(crcs, pa.int64())], schema=_CHECKED)


_LINKS = pa.schema([("bucket", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("tail", pa.int64())])
_LINKS_SQL = "bucket int, place long, doc_id long, digest binary, n long, tail long"


def _links(batches):
    """A row for each chunk of each recipe, after the recipe is checked against its Merkle root; tail: bytes of the document behind it."""
    for batch in batches:
        found, ns, counts = [], [], []
        for doc_id, n_tokens, root, links in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root", "links")), strict=True):
            k = len(links) // (DIGEST + 4)
            digests = [links[i * DIGEST : (i + 1) * DIGEST] for i in range(k)]
            lengths = np.frombuffer(links, "<u4", k, k * DIGEST)
            if merkle(digests) != root or int(lengths.sum()) != n_tokens:
                raise ValueError(f"recipe of document {doc_id} does not match its root")
            found += digests
            ns.append(lengths)
            counts.append(k)
        if not found:
            continue
        n, at = np.concatenate(ns).astype(np.int64), np.repeat(np.arange(len(counts)), counts)
        total = batch.column("n_tokens").to_numpy()
        done = np.cumsum(n) - (np.cumsum(total) - total)[at]
        taken = pa.array(at)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in ("bucket", "place", "doc_id")), pa.array(found, pa.binary()), pa.array(n), pa.array(4 * (total[at] - done))], schema=_LINKS)


_SHIFTED = pa.schema([("bucket", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])


def _shifted(batches):
    for batch in batches:
        crc = crc_shift(batch.column("crc").to_numpy(), batch.column("tail").to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "place", "doc_id", "n")), pa.array(crc)], schema=_SHIFTED)


def _verified(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(links of all recipes, first place of each bucket) after the recipes are checked against the manifest."""
    recipes, kept = _recipes(spark, path), spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    if sorted((*r[:4], bytes(r["root"])) for r in kept.collect()) != sorted(manifest_of(recipes)):  # at most MOST_BUCKETS rows
        raise ValueError("the recipes do not match the manifest")
    return mapped(recipes, _links, _LINKS_SQL), kept.where("bucket >= 0").select("bucket", "first")


def _joined(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links with their chunks (digest, size, ...); a missing chunk or one of another length stops the query."""
    found = links.join(chunks, "digest", "left")
    wrong = F.raise_error(F.concat(F.lit("a chunk is missing or too long for "), F.coalesce(F.col("doc_id").cast("string"), F.lit("a document")))).cast("long")
    return found.withColumn("n", F.when(F.col("size") == F.col("n"), F.col("n")).otherwise(wrong))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: chunks, recipes and manifest are all checked.

    A document's crc32 is put together from its chunks' own, so payloads are read once, where they lie, and never shuffled.
    """
    links, firsts = _verified(spark, path)
    chunks = mapped(_read_parts(spark, path, 1).select("key", "width", "n_ids", "payload"), _checked, "digest binary, size long, crc long")
    joined = _joined(links, chunks).select("bucket", "place", "doc_id", "n", "tail", "crc")
    shifted = mapped(joined, _shifted, "bucket int, place long, doc_id long, n long, crc long")
    docs = shifted.groupBy("bucket", "place", "doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return docs.join(F.broadcast(firsts), "bucket").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: the whole id streams back from recipes and chunks. Payloads travel to their documents, once for each use."""
    links, firsts = _verified(spark, path)
    chunks = _read_parts(spark, path, 1).select(F.col("key").alias("digest"), F.col("n_ids").alias("size"), "width", "payload")
    whole = _joined(links, chunks).groupBy("bucket", "place", "doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("tail")).alias("at"), "width", "payload"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([unpack(p["width"], p["payload"]) for p in parts]).tolist() for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "place", "doc_id")), pa.array(ids, pa.list_(pa.int64()))], names=["bucket", "place", "doc_id", "ids"])

    found = mapped(whole, run, "bucket int, place long, doc_id long, ids array<long>")
    return found.join(F.broadcast(firsts), "bucket").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "ids")


def stored_digest(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the store and return what reading it back gives."""
    path = path or shared_dir(docs.sparkSession)
    write_store(docs, path, tokenizer_path, **options)
    return stored(read_store(docs.sparkSession, path))
