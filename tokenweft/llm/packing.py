"""Operator 7: best-fit packing of token streams by linear grouping.

Texts become ids (end id appended); only longer ones than a sequence are cut. Pieces of one length are
interchangeable, so the whole plan is made on the histogram of lengths, which has at most `capacity` entries
however many documents there are:

1. Full pieces take a sequence each.
2. Large lengths (over `small`) are sorted and dealt into `groups` groups of equal cardinality; every length
   counts as the longest of its group, so that few sizes remain. Configurations of those sizes (multisets that
   fit) are generated by pricing: a knapsack over the dual prices of a multiplicative-weights covering
   programme proposes a configuration, and each is applied as often as the remaining counts allow.
3. Configurations are filled with actual documents: each place of a group takes its longest remaining piece.
   A sequence then holds less than the rounded sizes said; places without a piece stay open.
4. Remaining pieces, from the longest to the shortest, go to the open sequence that they fill best, on classes
   of sequences with equal room; a new sequence is opened only if no open one has room.

The plan is a table of (length, first rank, count, first sequence, offset) runs. Pieces get a rank among those
of their length from a local rank within their slice of the input and offsets of the slices, so that no group
of equal lengths meets in one task.

Cases: null and empty texts are the end id alone; equal doc_ids are packed separately; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenweft.llm._common import mapped, release, stored, text_runs
from tokenweft.llm.segments import ended, library_encoder


def group_sizes(counts: np.ndarray, small: int, groups: int) -> list[list[int]]:
    """Lengths over `small`, ascending, in at most `groups` groups of about equal numbers of pieces; a length stays whole."""
    lengths = [s for s in range(small + 1, len(counts)) if counts[s]]
    total = int(sum(counts[s] for s in lengths))
    out: list[list[int]] = []
    done = 0
    for s in lengths:
        if not out or done * groups >= total * len(out):
            out.append([])
        out[-1].append(s)
        done += int(counts[s])
    return out


def best_configuration(sizes: list[int], prices: np.ndarray, room: int, most: list[int]) -> Counter:
    """The multiset of sizes within room of the highest price, none more often than `most`: a bounded knapsack."""
    value = np.zeros(room + 1)
    picks = []
    for size, price, limit in zip(sizes, prices.tolist(), most, strict=True):
        for _ in range(min(limit, room // size)):
            taken = value.copy()
            taken[size:] = value[:-size] + price
            better = taken > value + 1e-12
            picks.append((size, better))
            value = np.where(better, taken, value)
    at, out = int(np.argmax(value)), Counter()
    for size, better in reversed(picks):
        if better[at]:
            out[size] += 1
            at -= size
    return out


def configurations(sizes: list[int], counts: list[int], room: int, rounds: int = 200) -> list[tuple[Counter, int]]:
    """(configuration, times) that cover no more than the counts; what is left over goes to best fit.

    The dual prices start in proportion to size; every configuration used makes the sizes that lag behind dearer.
    """
    left = np.array(counts, np.int64)
    prices = np.array(sizes, float) / room
    found: list[tuple[Counter, int]] = []
    for _ in range(rounds):
        live = [i for i in range(len(sizes)) if left[i]]
        if not live:
            break
        pick = best_configuration([sizes[i] for i in live], prices[live], room, [int(left[i]) for i in live])
        if not pick:
            break
        used = sum(s * n for s, n in pick.items())
        if used < 0.97 * room and len(found) > 0:
            break  # nothing full is left: best fit with real lengths does the rest
        times = min(int(left[sizes.index(s)]) // n for s, n in pick.items())
        step = max(1, times // 4) if times > 16 else times
        for s, n in pick.items():
            i = sizes.index(s)
            left[i] -= step * n
            prices[i] *= 0.98
        found.append((pick, step))
        prices *= np.where(left > 0, 1.0, 0.0)
        prices /= max(prices.max(), 1e-9)
        prices = np.where(left > 0, 0.5 * prices * np.array(sizes) / max(sizes) + 0.5 * np.array(sizes) / max(sizes), 0)
    return found


def plan(counts: np.ndarray, capacity: int = 2048, small: int = 256, groups: int = 64) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The shorter of two plans: that of linear grouping, and best fit alone, which some histograms suit better (all lengths over `small` grouped into none)."""
    return min((_plan(counts, capacity, s, groups) for s in (small, capacity)), key=lambda found: found[1])


def _plan(counts: np.ndarray, capacity: int, small: int, groups: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) over the histogram counts[length], and the number of sequences."""
    left = np.array(counts, np.int64)
    taken = np.zeros(len(left), np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number of sequences)

    def put(size: int, number: int, sequence: int, offset: int) -> None:
        out.append((size, int(taken[size]), number, sequence, offset))
        taken[size] += number
        left[size] -= number

    def give(room: int, first: int, number: int) -> None:
        if room > 0:
            open_bins.setdefault(room, []).append((first, number))

    if left[capacity]:
        n = int(left[capacity])
        put(capacity, n, 0, 0)
        sequences = n
    dealt = group_sizes(left, small, groups)
    sizes = [g[-1] for g in dealt]
    by_size = dict(zip(sizes, dealt, strict=True))
    for pick, times in configurations(sizes, [int(sum(left[s] for s in g)) for g in dealt], capacity):
        places = [s for s, n in sorted(pick.items(), reverse=True) for _ in range(n)]
        bins = [(sequences, times, 0)]  # first sequence, number, filled
        sequences += times
        for rounded in places:
            following = []
            for first, number, filled in bins:
                while number:
                    size = next((s for s in reversed(by_size[rounded]) if left[s]), None)
                    if size is None:
                        following.append((first, number, filled))
                        break
                    k = min(number, int(left[size]))
                    put(size, k, first, filled)
                    following.append((first, k, filled + size))
                    first, number = first + k, number - k
            bins = following
        for first, number, filled in bins:
            give(capacity - filled, first, number)
    rooms = sorted(open_bins)
    import bisect

    for size in range(len(left) - 1, 0, -1):
        while left[size]:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                full, rest = divmod(int(left[size]), per)
                for k, number in ((per, full), (rest, 1 if rest else 0)):
                    if k and number:
                        for j in range(k):
                            put(size, number, sequences, j * size)
                        room = capacity - k * size
                        if room:
                            if room not in open_bins:
                                bisect.insort(rooms, room)
                            give(room, sequences, number)
                        sequences += number
                continue
            room = rooms[at]
            first, number = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            k = min(number, int(left[size]))
            put(size, k, first, capacity - room)
            for r, f, n in ((room - size, first, k), (room, first + k, number - k)):
                if n and r:
                    if r not in open_bins:
                        bisect.insort(rooms, r)
                    give(r, f, n)
    return out, sequences


#: Weight of a worker's table of segments: two of them stand beside an executor's heap, which earlier stages may have filled.
TABLE_BYTES = 100_000_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slice long, local long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("slice", pa.int64()), ("local", pa.int64())])


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, seen, part = library_encoder(path, TABLE_BYTES), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for batch in text_runs(whole, limit=1_500_000):
                rows, at = [], 0
                ids, counts = ended(*encoder.block(batch.column("text")), end_id)
                data = ids.tobytes()
                for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    start, piece = 0, 0
                    while start < n:
                        length = (n - 1) % capacity + 1 if not piece else capacity
                        rows.append((doc_id, piece, start, length, zlib.crc32(data[4 * (at + start) : 4 * (at + start + length)]), part, int(seen[length])))
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                    at += n
                release()  # between blocks a worker holds little more than its table
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES_ARROW.types, strict=True)], schema=_PIECES_ARROW)

    return run


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(table: np.ndarray):
    """table: the runs as columns, sorted by (length, first rank)."""
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(table[at, 4])], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, small: int = 256, groups: int = 64) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(mapped(rows, _cut(tokenizer_path, end_id, capacity), _PIECES))
    tally = pieces.groupBy("slice", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    found, _ = plan(counts, capacity, small, groups)
    table = np.array(sorted(found) or [(0, 0, 0, 0, 0)], np.int64)
    w = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = tally.withColumn("before", F.sum("n").over(w) - F.col("n")).drop("n")
    ranked = pieces.join(offsets, ["slice", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    return mapped(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), _place(table), _PLACED)
