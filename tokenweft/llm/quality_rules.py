"""Operator 6: quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (words, and windows of one to three word shapes): the trusted target, from
documents labelled good, and the raw corpus, from every document. A document's score is the mean over its
n-grams of log p_target - log p_raw; it is kept if no base rule fails and the score reaches a fixed threshold.

The raw counts cover all documents: every task sums its own into a sparse vector of at most 2**bits entries,
which Spark adds up before 2**bits sums go to the driver. The target counts every document labelled good, in the same pass. Up to
`max_shipped` trusted ids travel to all tasks as sorted longs; more of them are joined, which shuffles the texts.

Cases: null and empty texts have no words and fail the base rules; no trusted rows at all give a ratio of 0 for
every document, so that only base rules decide; equal doc_ids are scored separately; other columns, whatever
their names, are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweft.llm._common import SHIPPED, among, filtered, mapped, shipped, text_runs
from tokenweft.llm.words import Block, mix, word_table

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 50, 50, 3

BITS = 16
THRESHOLD = -0.5


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(SPACES))
        seen.add(line)
    return n


def repeated_words(block: Block) -> np.ndarray:
    """For each text its words inside windows of WINDOW that occur twice or more in it, the first occurrence included."""
    key, doc = block.windows(block.table.hashes(block.rows), WINDOW)
    key = mix(key, doc.astype(np.uint64))
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    twice = np.zeros(len(key), bool)
    twice[order[same]] = twice[order[same + 1]] = True
    first = np.cumsum(block.counts) - block.counts
    before = np.cumsum(np.maximum(block.counts - WINDOW + 1, 0)) - np.maximum(block.counts - WINDOW + 1, 0)
    starts = (np.arange(len(key)) - before[doc] + first[doc])[twice]
    cover = np.zeros(len(block.rows), bool)
    for i in range(WINDOW):
        cover[starts + i] = True
    return np.bincount(block.doc[cover], minlength=len(block.texts))


def _count(bits: int, known: Broadcast | None):
    """(bucket, raw, target) sums of a task over (doc_id, text), or (trusted, text) where the ids are not shipped."""

    def run(batches):
        table, size = word_table(True), 1 << bits
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for whole in batches:
            for batch in text_runs(whole):
                buckets, doc = Block(table, batch.column("text").to_pylist()).features(bits)
                raw += np.bincount(buckets, minlength=size)
                good = batch.column("trusted").to_numpy(zero_copy_only=False) if known is None else among(known.value, batch.column("doc_id"))
                if good.any():
                    target += np.bincount(buckets[good[doc]], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all rows labelled good (1 by every label row of that id)."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    return good.where("q = 1 and doc_id is not null").select("doc_id")


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_shipped: int = SHIPPED) -> np.ndarray:
    """log p_target - log p_raw for each bucket, both smoothed by one count spread over all buckets."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = trusted_ids(labels)
    known = shipped(good, max_shipped)
    if known is None:
        marked = marked.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = mapped(marked, _count(bits, known), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    got = sums.toPandas()  # at most 2**bits rows
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    if not target.sum():
        return np.zeros(1 << bits, np.float32)
    size = 1 << bits
    return (np.log((target + 0.5) / (target.sum() + 0.5 * size)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * size))).astype(np.float32)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("llr", pa.float64())])
_OUT_SQL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def judge(texts: list[str | None], ratios: np.ndarray, bits: int, threshold: float) -> list[np.ndarray]:
    """The columns from n_words on for some texts."""
    block = Block(word_table(True), texts)
    n = block.counts
    texts = [t or "" for t in texts]
    chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    lines = np.array([duplicate_lines(t) for t in texts], np.int64)
    repeats = repeated_words(block)
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEATED_PERCENT * n)
    buckets, doc = block.features(bits)
    total = np.bincount(doc, weights=ratios[buckets], minlength=len(texts))
    llr = total / np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    return [n, chars, symbols, lines, repeats, failed, ~failed & (llr >= threshold), llr]


def score(docs: DataFrame, ratios: np.ndarray, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document, in no order."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        table = shared.value
        for whole in batches:
            for batch in text_runs(whole):
                columns = judge(batch.column("text").to_pylist(), table, bits, threshold)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], schema=_OUT)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _OUT_SQL)


def rules(docs: DataFrame, labels: DataFrame, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(docs, labels, bits), bits, threshold)


def keep(docs: DataFrame, ratios: np.ndarray, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    return filtered(docs, lambda batch: judge(batch.column("text").to_pylist(), shared.value, bits, threshold)[6])
