"""Operator 5 [native]: order MinHash fingerprints of whole texts, with DataFrame functions only.

The k-mers of a text are windows of K tokens. A token is a word; in scripts written without blanks, and in runs of more than
LONGEST characters, it is one character. Each k-mer is numbered by its occurrence, and (k-mer, number) is hashed to a
point of a ring. Each of M selections takes the LENGTH points that follow its own fixed point of the ring: the least ones
under a permutation of its own, a rotation, out of all k-mers. The chosen k-mers are put back into text order and the tuple
is hashed: one of the M parts of the signature. Equal parts count as likeness; since order is kept, moving
or replacing text lowers it as edit distance does.

Everything happens inside a row, on arrays of numbers: k-mers are sorted once to number them and once around the
ring, and a selection is a binary search, so the time for a text of n k-mers is that of two sorts, and nothing is exploded.

Documents are dealt into ordered buckets of doc_id (quantiles, a literal of at most 16,384 numbers); the next document
is the next row of the bucket or the head of the bucket below, so no task orders the table. Rows without an id, and those of
an id that fills a bucket alone, are dealt further by the hash that orders them.

Cases: a null text is empty; an empty fingerprint has M dashes; two empty ones have likeness 1; texts shorter than K
tokens are one k-mer; null doc_ids come last, equal ones are ordered by a hash of their text; after the last document
comes the first, so a lone document follows itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenweft.llm._common import bucket_of, quantiles

K, M, LENGTH, LONGEST = 2, 32, 2, 24
_BLANK = " \\t\\n\\x0B\\f\\r"
#: Thai and Lao, Burmese, Khmer, kana, and Han, which are written without blanks.
_DENSE = "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{323AF}"
TOKEN = f"[^{_BLANK}{_DENSE}]{{1,{LONGEST}}}+(?![^{_BLANK}{_DENSE}])|[^{_BLANK}]"
_EMPTY = "--------"
_ring = random.Random(20_240_601)
#: The fixed points of the selections.
POINTS = [_ring.randrange(-(1 << 63), 1 << 63) for _ in range(M)]


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add next_<column> of the next row, in the order of rn within a bucket and of buckets from the highest down; the last row's is the first."""
    w = Window.partitionBy("bucket").orderBy("rn")
    pair = F.struct(*columns)
    led = rows.withColumn("_led", F.lead(pair).over(w))
    heads = rows.where("rn = 1").select("bucket", F.struct(*columns).alias("_head"))
    down = Window.orderBy(F.col("bucket").desc())  # one row a bucket
    everywhere = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("bucket", F.coalesce(F.lead("_head").over(down), F.first("_head").over(everywhere)).alias("_below"))
    joined = led.join(following, "bucket", "left").withColumn("_next", F.coalesce("_led", "_below"))
    return joined.select(*rows.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))


def kmers_of(text: Column) -> Column:
    """Hashes of all windows of K tokens; of all tokens where they are fewer."""

    def windows(tokens: Column) -> Column:
        kept = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (K - 1), F.least(F.size(tokens), F.lit(1))))
        return F.transform(kept, lambda w, i: F.xxhash64(w, *(F.get(tokens, i + j) for j in range(1, K))))

    return let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), windows)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _low(n: Column) -> Column:
    """A mask of as many low bits as the numbers below n need."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - F.lit(1).cast("long")


def ring_of(kmers: Column) -> Column:
    """For each k-mer a number with the hash of (k-mer, occurrence) in its high bits and the k-mer's place in its low bits, sorted."""

    def numbered(low: Column) -> Column:
        high = F.bitwise_not(low)
        packed = F.sort_array(F.transform(kmers, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))

        def points(s: Column) -> Column:
            def alike(v: Column, j: Column, back: Column) -> Column:
                return (j >= back) & (F.get(s, j - back).bitwiseXOR(v).bitwiseAND(high) == 0)

            def before(v: Column, j: Column) -> Column:
                """How many equal k-mers stand before: the longest step back to an equal one, bit by bit from the highest."""
                steps = F.transform(F.sequence(F.length(F.bin(F.size(s))), F.lit(0)), lambda b: F.call_function("shiftleft", F.lit(1), b))
                return F.when(alike(v, j, F.lit(1)), F.aggregate(steps, F.lit(0), lambda t, d: F.when(alike(v, j, t + d), t + d).otherwise(t))).otherwise(0)

            return F.transform(s, lambda v, j: F.xxhash64(F.get(kmers, v.bitwiseAND(low).cast("int")), before(v, j)).bitwiseAND(high).bitwiseOR(v.bitwiseAND(low)))

        return F.sort_array(let(packed, points))

    return let(_low(F.size(kmers)), numbered)


def signature(kmers: Column) -> Column:
    """M parts of eight characters, in order."""

    def parts(ring: Column) -> Column:
        n = F.size(ring)

        def part(point: Column, steps: Column, low: Column) -> Column:
            at = F.aggregate(steps, F.lit(0), lambda t, d: F.when((t + d <= n) & (F.get(ring, t + d - 1) < point), t + d).otherwise(t))  # numbers below the point
            places = F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda j: F.get(ring, F.pmod(at + j, n)).bitwiseAND(low).cast("int"))
            chosen = F.transform(F.array_sort(F.array_distinct(places)), lambda p: F.get(kmers, p))
            code = F.xxhash64(F.size(chosen), chosen)
            return F.lpad(F.lower(F.hex(code.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")

        points = F.array(*(F.lit(p).cast("long") for p in POINTS))
        steps = F.transform(F.sequence(F.length(F.bin(n)), F.lit(0)), lambda b: F.call_function("shiftleft", F.lit(1), b))
        found = let(steps, lambda st: let(_low(n), lambda low: F.array_join(F.transform(points, lambda p: part(p, st, low)), "")))
        return F.when(n == 0, F.lit(_EMPTY * M)).otherwise(found)

    return let(ring_of(kmers), parts)


def bucket_and_place(rows: DataFrame, rows_per_bucket: int = 500, most: int = 16_384) -> DataFrame:
    """rows with bucket and rn: descending doc_id, nulls last, equal ones by a hash of the text."""
    bounds, heavy = quantiles(rows.select("doc_id"), "doc_id", rows_per_bucket, most)
    h = F.xxhash64("text")
    fine = F.lit(1023) - F.call_function("shiftright", h, F.lit(55)) - F.lit(256)  # 512 parts, the least hash highest
    id_ = F.col("doc_id")
    coarse = F.when(id_.isNull(), -1).otherwise(bucket_of(id_, bounds)).cast("long") * 1024
    alone = id_.isNull() | (id_.isin(heavy) if heavy else F.lit(False))
    dealt = rows.withColumn("bucket", coarse + F.when(alone, fine).otherwise(0))
    w = Window.partitionBy("bucket").orderBy(id_.desc_nulls_last(), h)
    return dealt.withColumn("rn", F.row_number().over(w))


def ordered(docs: DataFrame) -> DataFrame:
    """bucket, rn, doc_id, text, next_text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_next(bucket_and_place(rows), ["text"])


def edited(text: Column, following: Column) -> Column:
    """The last third (rounded down) of the code points replaced by as many from the head of the next text, or all of it."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that either fingerprint has; 1 if neither has any."""
    places = F.array(*(F.lit(8 * j + 1) for j in range(M)))
    part = lambda s, at: F.substring(s, at, F.lit(8))
    some = F.size(F.filter(places, lambda at: (part(a, at) != _EMPTY) | (part(b, at) != _EMPTY)))
    equal = F.size(F.filter(places, lambda at: (part(a, at) != _EMPTY) & (part(a, at) == part(b, at))))
    return F.when(some == 0, 1.0).otherwise(equal / some)


def fingerprint(text: Column) -> Column:
    return let(kmers_of(text), signature)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = ordered(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    found = base.select(
        "bucket", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
    )
    out = with_next(found, ["fingerprint"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
