"""Operator 1: a naive-Bayes support-vector quality classifier.

Indicators of hashed n-grams (words, and windows of one to three word shapes) are scaled by the log-count ratio
of the classes; a linear hinge-loss model is fitted on the unit-length rows by dual coordinate descent; a sigmoid
fitted on a fifth of the sample, kept apart from the descent, turns margins into scores.

Fitting uses at most `max_rows` labelled training rows, the first by a hash of their id (MAX_ROWS below); their
ids are broadcast, their indicators gathered on the driver: bounded by that parameter and by MAX_FEATURES in all (4 bytes each). Scoring is one pass
over all documents with a model of 2**bits weights. Labels, lang, source and doc_id are no inputs of a score.

Cases: null and empty texts have no n-grams and get the score of the bias alone; without rows of both classes
every score is the share of label 1 among the training rows (0.5 without any); conflicting label rows of an id
are left out of training; equal doc_ids are scored separately; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweft.llm._common import bounded, crc_mod, filtered, hash_sample, mapped, text_runs
from tokenweft.llm.words import Block, word_table

BITS = 18
MAX_ROWS, MAX_FEATURES = 12_000, 24_000_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def training_ids(labels: DataFrame, label: str, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, y) of all labelled training ids; ids with conflicting labels are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(f"doc_id is not null and y in (0, 1)")
    rows = rows.where(crc_mod(F.col("doc_id"), folds) != held_out)
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")


def sample_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` of the training ids, the first by a hash."""
    return hash_sample(training_ids(labels, label), "doc_id", most)


def indicators(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, texts): each n-gram bucket of a text once, in the order of the texts."""
    buckets, doc = block.features(bits)
    key = np.unique((doc << bits) | buckets)
    return key & ((1 << bits) - 1), key >> bits


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the hinge loss over unit-length rows; the last weight is the bias.

    rows: indicator buckets; values are r at the buckets. c: the upper bound of each row's dual variable.
    """
    w = np.zeros(len(r) + 1)
    values = []
    for f in rows:
        v = np.append(r[f], 1.0)
        values.append(v / np.sqrt((v * v).sum()))
    at = [np.append(f, len(r)) for f in rows]
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            g = y[i] * (w[at[i]] @ values[i]) - 1.0
            new = min(max(alpha[i] - g, 0.0), c[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at[i]] += step * y[i] * values[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))): damped Newton steps on smoothed targets, margins scaled to unit spread first."""
    pos = int((y > 0).sum())
    neg = len(y) - pos
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    middle, spread = float(margins.mean()), float(margins.std()) or 1.0
    x = np.stack([(margins - middle) / spread, np.ones_like(margins)])

    def loss(v: np.ndarray) -> float:
        z = v @ x
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5e-3 * (v @ v))

    v = np.array([1.0, 0.0])
    now = loss(v)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v @ x, -35, 35)))
        grad = x @ (p - target) + 1e-3 * v
        move = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), grad)
        scale = 1.0
        while scale > 1e-6 and loss(v - scale * move) > now:
            scale /= 2
        v = v - scale * move
        before, now = now, loss(v)
        if before - now < 1e-9:
            break
    a = float(v[0] / spread)
    return a, float(v[1] - a * middle)


@dataclass
class Model:
    bits: int
    weight: np.ndarray  # weight * ratio of each bucket
    square: np.ndarray  # ratio squared
    bias: float
    a: float
    b: float

    def scores(self, block: Block) -> np.ndarray:
        buckets, doc = indicators(block, self.bits)
        n = len(block.texts)
        dot = np.bincount(doc, weights=self.weight[buckets], minlength=n) + self.bias
        margin = dot / np.sqrt(np.bincount(doc, weights=self.square[buckets], minlength=n) + 1.0)
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -35, 35)))


def fit_rows(rows: list[np.ndarray], y: np.ndarray, bits: int) -> Model:
    """y: 0 or 1 for each row of indicators."""
    size, zero = 1 << bits, np.zeros(1 << bits, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(bits, zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    learn = np.flatnonzero(~apart)
    counts = np.zeros((2, size))
    for i in learn:
        counts[y[i]][rows[i]] += 1
    n = np.array([(y[learn] == k).sum() for k in (0, 1)])
    share = (counts + 0.5) / (n[:, None] + 1.0)
    r = np.where(counts.sum(0) > 0, np.log(share[1] / share[0]), 0.0)
    signs = np.where(y == 1, 1.0, -1.0)
    c = np.where(y == 1, len(learn) / (2 * n[1]), len(learn) / (2 * n[0]))
    w = dual_coordinate_descent([rows[i] for i in learn], signs[learn], r, c[learn])
    check = np.flatnonzero(apart) if apart.any() else learn
    margins = []
    for i in check:
        v = r[rows[i]]
        margins.append((w[:-1][rows[i]] @ v + w[-1]) / np.sqrt((v * v).sum() + 1.0))
    a, b = sigmoid_fit(np.array(margins), signs[check])
    return Model(bits, (w[:-1] * r).astype(np.float32), (r * r).astype(np.float32), float(w[-1]), a, b)


def _gather(bits: int):
    def run(batches):
        table = word_table(True)
        for whole in batches:
            for batch in text_runs(whole):
                buckets, doc = indicators(Block(table, batch.column("text").to_pylist()), bits)
                ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(buckets, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), lists], names=["doc_id", "y", "buckets"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    sample = F.broadcast(sample_ids(labels, label, max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("doc_id", "text", "y")
    found = bounded(mapped(rows, _gather(bits), "doc_id long, y int, buckets array<int>"), F.size("buckets"), max_rows, max_features)
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    order = order[np.random.default_rng(11).permutation(len(order))]
    lists, y = found["buckets"].combine_chunks(), found["y"].to_numpy()
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]) if len(lists) else np.zeros(1, int)
    return fit_rows([flat[ends[i] : ends[i + 1]] for i in order], y[order].astype(int), bits)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found, table = shared.value, word_table(True)
        for whole in batches:
            for batch in text_runs(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.scores(Block(table, batch.column("text").to_pylist())))], schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = mapped(rows, run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, bits: int = BITS, max_rows: int = MAX_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, label, bits, max_rows), threshold)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda batch: shared.value.scores(Block(word_table(True), batch.column("text").to_pylist())) >= threshold)
