"""Operator 3: an n-gram Jaccard join by chosen paths.

Every text is the set of its word shingles (WIDTH words; a shorter text is one shingle of all its words). Sets
are embedded as 128 minimum hashes, so that two sets agree in a coordinate with a probability equal to their
Jaccard similarity. A run samples a coordinate and splits all sets by its value; small buckets are compared by brute
force, those over LIMIT are split again, each into several children by further sampled coordinates. Runs repeat until the chance to miss a pair at the threshold falls below 1 - recall.

1. Equal sets collapse to one representative first, so copies never meet in a bucket.
2. In a bucket, sets whose embeddings agree closely enough (`cut`: a pair at the threshold falls short with 1.4e-6) are joined by
   union-find; the bucket gives a link to the local root for each set, not its pairs. All members of a bucket over LIMIT
   go on to its split. A bucket that a split would not make cheaper (near copies, a passage that is most of its texts), or
   whose run has no coordinates left, is finished instead: it is dealt into chunks by hash, and what these and the small
   buckets leave outside its largest component meets the whole bucket in pairs of blocks. Pairs within one component
   need no comparison, so a large group of near copies costs little more than its chunks, and no task holds a large group.
3. Components of those links contain every true class. Inside each, exact set intersections decide: a component
   is cut into blocks of about BLOCK sets, every pair of blocks is one task's unit, and what it returns is each
   set's number of links and its local root - never the pairs. Long sets travel in slices by ranges of their hashes, and a unit adds up
   its intersections range by range, so that a task holds about SPAN shingles however long the texts are. Components of these exact links are the classes.

The result has one row for each document: class_id (least doc_id of the class), n_links (different texts, that is
representatives, with similarity >= threshold), n_copies (documents with this document's very set), class_size
(documents of the class). No partner is capped, and no links or sets of the corpus go to the driver.

Cases: null and empty texts have the empty set and are copies of each other; equal doc_ids are separate rows; a
null doc_id takes part (its class_id is the least other id, or null); an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenweft.llm._common import attach, is_shipped, mapped, shipped, stored, text_runs
from tokenweft.llm.components import components, join_hubs
from tokenweft.llm.words import grams, word_table, words

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.99999
COORDINATES, LIMIT, CHILDREN, BLOCK = 128, 1000, 3, 800
#: Shingles of a unit that a task holds at once (8 bytes each, and about ten times that for their intersections).
SPAN = 1_000_000
_RUN = np.uint64(127)  # the low bits of a path: its run

_seeds = np.random.default_rng(20_240_601)
_XOR = _seeds.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_ODD = _seeds.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def n_runs(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has shared a bucket with probability `recall`."""
    return min(COORDINATES, max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))))


def cut(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Most coordinates to ask for so that a pair at the threshold has fewer with at most 0.15 of the chance that `recall` leaves."""
    missed = 0.0
    for need in range(COORDINATES + 1):
        missed += math.comb(COORDINATES, need) * threshold**need * (1 - threshold) ** (COORDINATES - need)
        if missed > 0.15 * (1 - recall):
            break
    return need


def n_levels(runs: int) -> int:
    """Splits below a root: each takes CHILDREN further coordinates that only its run has."""
    return (COORDINATES - runs) // runs // CHILDREN


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    table = word_table(False)
    table.trim()
    rows = table.rows(words(text))
    if not len(rows):
        return np.empty(0, np.uint64)
    return np.unique(grams(table.hashes(rows), min(width, len(rows))))


def set_key(found: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def embed(found: np.ndarray) -> np.ndarray:
    """The least hash under each of COORDINATES functions; all ones for the empty set."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(found), 2048):
        least = np.minimum(least, ((found[s : s + 2048, None] ^ _XOR) * _ODD).min(0))
    return least


_SETS = "row long, doc_id long, h long, key_a long, key_b long, n int, tops binary, sig binary"


def _sets(width: int, runs: int):
    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in text_runs(whole):
                out = []
                for doc_id, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    found = shingles(text, width)
                    least = embed(found)
                    out.append((row, doc_id, h, *set_key(found), len(found), least[:runs].tobytes(), (least >> np.uint64(17)).astype("<u2").tobytes()))
                    row += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 5, pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["row", "doc_id", "h", "key_a", "key_b", "n", "tops", "sig"])

    return run


def _roots(batches):
    """(path, rep) of every run's root split; a path ends in its run."""
    for batch in batches:
        tops = np.frombuffer(b"".join(batch.column("tops").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        runs = tops.shape[1]
        path = (tops * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(runs, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        path = (path & ~_RUN) | np.arange(runs, dtype=np.uint64)
        rep = np.repeat(batch.column("rep").to_numpy(), runs)
        yield pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), pa.array(rep)], names=["path", "rep"])


def _children(depth: int, runs: int):
    """(path, rep, parent) of the next level: each node is split by the run's own CHILDREN coordinates of this depth."""
    each = (COORDINATES - runs) // runs

    def run(batches):
        for batch in batches:
            parent = batch.column("path").to_numpy().view(np.uint64)
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES).astype(np.uint64)
            outs = []
            for j in range(CHILDREN):
                at = (parent & _RUN) * np.uint64(each) + np.uint64(runs + CHILDREN * depth + j)
                node = (parent ^ (at << np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
                node ^= node >> np.uint64(32)
                value = np.take_along_axis(sig, at.astype(np.int64)[:, None], 1)[:, 0]
                path = (node * np.uint64(0x9E3779B97F4A7C15)) ^ (value + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
                outs.append(((path & ~_RUN) | (parent & _RUN)).view(np.int64))
            rep, parents = (np.tile(batch.column(c).to_numpy(), CHILDREN) for c in ("rep", "path"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(outs)), pa.array(rep), pa.array(parents)], names=["path", "rep", "parent"])

    return run


def _groups(batches, key: str) -> Iterator[pa.Table]:
    """Tables with the rows of whole runs of equal keys, from batches sorted by the key; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = len(k) - int(np.argmax(k[::-1] != k[-1])) if k[0] != k[-1] else 0
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _spans(k: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
    return zip(edges, edges[1:], strict=False)


def union(linked: np.ndarray) -> np.ndarray:
    """Least index of each member's component, from a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def agreement(sig: np.ndarray) -> np.ndarray:
    """For all pairs of rows the number of equal coordinates."""
    out = np.zeros((len(sig), len(sig)), np.uint8)
    for c in sig.T:
        out += c[:, None] == c[None, :]
    return out


def _loose(need: int):
    """(a, b): the link of each chunk member to its local root."""

    def run(batches):
        for table in _groups(batches, "chunk"):
            k, rep = (table.column(c).to_numpy() for c in ("chunk", "rep"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES)
            a, b = [], []
            for s, e in _spans(k):
                order = np.argsort(rep[s:e])
                r = rep[s:e][order]
                if e - s == 2:
                    if (sig[s] == sig[s + 1]).sum() >= need:
                        a.append(r[1:])
                        b.append(r[:1])
                    continue
                label = union(agreement(sig[s:e][order]) >= need)
                mine = np.flatnonzero(label != np.arange(e - s))
                a.append(r[mine])
                b.append(r[label[mine]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def _chunk_links(members: DataFrame, need: int) -> DataFrame:
    """members: chunk, rep, sig."""
    dealt = members.select("chunk", "rep", "sig").repartition("chunk").sortWithinPartitions("chunk")
    return stored(mapped(dealt, _loose(need), "a long, b long").distinct())


def _rest_links(rest: DataFrame, found: list[DataFrame], sigs: DataFrame, need: int) -> list[DataFrame]:
    """`found` and links that join all pairs of the buckets in rest(path, rep, size), which are over LIMIT."""
    chunk = F.xxhash64("path", F.pmod(F.xxhash64("rep", "path"), F.ceil(F.col("size") / LIMIT)))
    found = [*found, _chunk_links(rest.select(chunk.alias("chunk"), "rep").join(sigs, "rep"), need)]
    known = components(_all(found)).select(F.col("node").alias("rep"), "root")
    parts = stored(rest.join(known, "rep", "left").select("path", "rep", "size", F.coalesce("root", "rep").alias("root")))
    # pairs of one component are joined already: the rest of a bucket meets all of it, its largest component does not meet itself
    groups = parts.groupBy("path", "root").agg(F.count(F.lit(1)).alias("n"))
    most = groups.groupBy("path").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all")).where("most.n < all")
    most = stored(most.select("path", F.col("most.root").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / (LIMIT / 2)).alias("out"), F.ceil(F.col("most.n") / (LIMIT / 2)).alias("in")))
    if most.isEmpty():
        return found
    apart, hashed = F.col("root") != F.col("main"), F.xxhash64("rep", "path")
    block = F.when(apart, F.pmod(hashed, F.col("out"))).otherwise(F.col("out") + F.pmod(hashed, F.col("in")))
    last = F.when(apart, F.col("out") + F.col("in")).otherwise(F.col("out")) - 1
    units = parts.join(most, "path").join(sigs, "rep").select("path", "rep", "sig", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    units = units.where("block != other").withColumn("chunk", F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")))
    return [*found, _chunk_links(units, need)]


def loose_links(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links (a, b) whose components contain all pairs at the threshold, from reps(rep, tops, sig)."""
    need, runs = cut(threshold, recall), n_runs(threshold, recall)
    sigs = reps.select("rep", "sig")
    nodes = stored(mapped(reps.select("rep", "tops"), _roots, "path long, rep long"))
    found: list[DataFrame] = []
    rest: list[DataFrame] = []
    for depth in range(n_levels(runs) + 1):
        sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = nodes.join(sizes, "path")
        small = sized.where(F.col("size") <= LIMIT).join(sigs, "rep").select(F.col("path").alias("chunk"), "rep", "sig")
        found.append(_chunk_links(small, need))
        big = stored(sized.where(F.col("size") > LIMIT))
        if big.isEmpty():
            break
        if depth == n_levels(runs):
            rest.append(big)
            break
        split = stored(mapped(big.join(sigs, "rep").select("path", "rep", "sig"), _children(depth, runs), "path long, rep long, parent long"))
        # a split pays where CHILDREN buckets of the widest child's size have fewer pairs than the bucket itself
        widest = split.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.max("n").alias("n"))
        was = big.groupBy(F.col("path").alias("parent")).agg(F.max("size").alias("size"))
        stuck = stored(widest.join(was, "parent").where((F.col("n") > LIMIT) & (CHILDREN * F.col("n") * F.col("n") >= F.col("size") * F.col("size"))).select("parent"))
        rest.append(stored(big.join(stuck, big["path"] == stuck["parent"], "left_semi").select("path", "rep", "size")))
        nodes = stored(split.join(stuck, "parent", "left_anti").select("path", "rep"))
    rest = [r.select("path", "rep", "size") for r in rest if not r.isEmpty()]
    return _all(_rest_links(_all(rest), found, sigs, need) if rest else found)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cut_ranges(found: np.ndarray, parts: int) -> list[np.ndarray]:
    """The slices of a sorted set that lie in each of `parts` equal ranges of the hashes."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.split(found, np.searchsorted(found, edges))


def _keyed_sets(width: int):
    """The shingle set of each joined text in slices, kept where it is the wanted one (doc_ids may repeat). Slice 0 always comes; others only with shingles."""

    def run(batches):
        for whole in batches:
            for batch in text_runs(whole):
                rows, part, n, sets = [], [], [], []
                for i, (text, a, b, parts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "key_a", "key_b", "parts")), strict=True)):
                    found = shingles(text, width)
                    if set_key(found) != (a, b):
                        continue
                    for p, piece in enumerate(cut_ranges(found, parts)):
                        if not p or len(piece):
                            rows.append(i)
                            part.append(p)
                            n.append(len(found))
                            sets.append(piece.tobytes())
                own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("rep", "component", "blocks")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(part, pa.int32()), pa.array(n, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "component", "blocks", "part", "n", "found"])

    return run


def _hashes(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The 64-bit numbers in each row of a column of bytes, not copied."""
    out = []
    for chunk in column.chunks:
        chunk = chunk.cast(pa.large_binary())
        ends = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = chunk.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[: ends[-1]].view(np.uint64) if data is not None and len(chunk) and ends[-1] else np.empty(0, np.uint64)
        out += [flat[a:b] for a, b in zip((ends[:-1] // 8).tolist(), (ends[1:] // 8).tolist(), strict=True)]
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: a product over the shingles that at least two sets have."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    dense = np.cumsum(count > 1) - 1
    code, owner = dense[code[shared]], owner[shared]
    out, width = np.zeros((len(sets), len(sets)), np.float32), int((count > 1).sum())
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for s in range(0, width, 4096):
        a, b = np.searchsorted(code, (s, s + 4096))
        part = np.zeros((len(sets), min(4096, width - s)), np.float32)
        part[owner[a:b], code[a:b] - s] = 1
        out += part @ part.T
    return out


def _linked(unit: tuple, threshold: float) -> pa.RecordBatch:
    """(rep, links, root) of each set of a unit: its reps, blocks, sizes and intersections, and whether only pairs of two blocks count."""
    r, blk, n, both, cross = unit
    with np.errstate(invalid="ignore", divide="ignore"):
        linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    counted = linked & (blk[:, None] != blk[None, :]) if cross else linked
    return pa.RecordBatch.from_arrays([pa.array(r), pa.array(counted.sum(1).astype(np.int64)), pa.array(r[union(linked)])], names=["rep", "links", "root"])


def _exact(threshold: float):
    """(rep, links, root) of each set in each pair of blocks, from rows sorted by unit and part."""

    def run(batches):
        unit: tuple | None = None
        for table in _groups(batches, "cell"):
            cell, part, rep, block, cross, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "rep", "block", "cross", "n"))
            found = _hashes(table.column("found"))
            for s, e in _spans(cell):
                r, first = np.unique(rep[s:e], return_index=True)  # ascending; a text that came twice counts once
                if not part[s]:  # all sets of a unit have a slice 0
                    if unit:
                        yield _linked(unit, threshold)
                    unit = r, block[s:e][first], n[s:e][first].astype(float), np.zeros((len(r), len(r))), cross[s]
                at = np.searchsorted(unit[0], r)
                unit[3][np.ix_(at, at)] += intersections([found[s + i] for i in first])
            del table, found
        if unit:
            yield _linked(unit, threshold)

    return run


def parted(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows that may have one of the keys, the others); (all rows, None) where the keys are too many to travel.

    Keys are hashes, so the first rows still take the exact join; the others need none, and their texts are not shuffled.
    """
    attach(docs.sparkSession)
    known = shipped(keys)
    if known is None:
        return docs, None
    return docs.where(is_shipped(key, known)), docs.where(~is_shipped(key, known))


def exact_links(docs: DataFrame, members: DataFrame, width: int, threshold: float) -> DataFrame:
    """(rep, links, root) rows, one for each unit a set is in; members: rep, doc_id, key_a, key_b, component, blocks, parts."""
    # a merge join at every size: the members grow with the input, so they are never broadcast; texts whose ids none of them has stay out of its shuffle
    some, _ = parted(docs.select(F.col("doc_id").alias("at"), "text"), F.xxhash64("at"), members.select(F.xxhash64("doc_id")))
    texts = some.join(members.hint("merge"), F.col("at").eqNullSafe(F.col("doc_id")))
    sets = mapped(texts.select("rep", "component", "blocks", "parts", "key_a", "key_b", "text"), _keyed_sets(width), "rep long, component long, blocks int, part int, n long, found binary")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    units = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumn("unit", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))).withColumn("cross", F.col("blocks") > 1)
    # with several blocks a block meets itself inside every cross unit; its own pairs are counted in the unit (b, b) alone
    units = units.withColumn("cross", F.col("cross") & (F.col("block") != F.col("other")))
    units = units.withColumn("cell", F.xxhash64("unit", "part"))
    dealt = units.select("unit", "part", "cell", "rep", "block", "cross", "n", "found").repartition("unit").sortWithinPartitions("unit", "part")
    return mapped(dealt, _exact(threshold), "rep long, links long, root long")


def text_hash(text: Column | str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    return classes(docs, width, threshold, recall).select("doc_id", "class_id", "n_links", "n_copies", "class_size")


def classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of near_join with h, a hash of the text, and root, a number that is the class's own even where no id is known."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(mapped(rows.withColumn("h", text_hash("text")), _sets(width, n_runs(threshold, recall)), _SETS))
    key = ["key_a", "key_b"]
    reps = sets.groupBy(*key).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("least"))
    reps = stored(reps)
    lone = reps.select("rep").join(sets.select(F.col("row").alias("rep"), "n", "tops", "sig"), "rep").where("n > 0")
    loose = components(loose_links(stored(lone.select("rep", "tops", "sig")), threshold, recall))
    # where a set's own row has a null doc_id, any null row may carry the text: the key decides
    found = stored(loose.join(sets.select(F.col("row").alias("node"), "doc_id", "n", *key), "node"))
    size = found.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.sum("n").alias("shingles"))
    size = size.withColumn("parts", F.ceil(F.least(F.col("blocks"), F.lit(2)) * F.col("shingles") / F.col("blocks") / SPAN).cast("int"))
    members = found.join(size, "root").select(F.col("node").alias("rep"), "doc_id", *key, F.col("root").alias("component"), "blocks", "parts")
    exact = stored(exact_links(rows, stored(members), width, threshold))
    links = exact.groupBy("rep").agg(F.sum("links").alias("n_links"))
    joined = components(exact.where("links > 0").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = reps.join(links, "rep", "left").join(joined.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "rep")))
    ids = named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n_copies").alias("class_size"))
    known = named.join(ids, "root").select(*key, "root", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "class_size")
    return sets.select("doc_id", "h", *key).join(known, key).select("doc_id", "class_id", "n_links", "n_copies", "class_size", "h", "root")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each class of found = classes(docs): of the least doc_id (a row without an id only where the class has none),
    and of rows that share this id that of the least hash of the text; of rows equal in both one stays, whichever comes first.

    What goes is found by (doc_id, hash), so that a row whose id stands in another class too keeps its own class's decision. Rows with no such
    pair are passed on where they are; only the texts of those that may go are shuffled.
    """
    rows = stored(found.select("root", "doc_id", "h"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("b"), F.count(F.lit(1)).alias("n"))
    marked = stored(join_hubs(rows, stored(least.where("n > 1")), "root", rows.count()))  # a class of one row loses nothing
    best = F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("h") == F.col("b.h"))
    going = stored(marked.where(~best).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct())
    again = stored(marked.where(best).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = lambda df: docs["doc_id"].cast("long").eqNullSafe(df["_id"]) & (text_hash(docs["text"].cast("string")) == df["_h"])
    key = F.xxhash64(F.col("doc_id").cast("long"), text_hash(F.col("text").cast("string")))
    some, others = parted(docs, key, going.select(F.xxhash64("_id", "_h")))
    kept = some.join(going, [some["doc_id"].cast("long").eqNullSafe(going["_id"]), text_hash(some["text"].cast("string")) == going["_h"]], "left_anti")
    kept = kept if others is None else kept.unionByName(others)
    if again.isEmpty():
        return kept
    once = docs.join(again, same(again), "left_semi").withColumn("_k", text_hash(F.col("text").cast("string"))).dropDuplicates(["doc_id", "_k"]).drop("_k")
    both = stored(going.unionByName(again.select("_id", "_h")))
    return docs.join(both, same(both), "left_anti").unionByName(once)
