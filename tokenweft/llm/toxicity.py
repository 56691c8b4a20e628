"""Operator 9: a convolutional text classifier for toxicity, trained in numpy.

A word (small letters, outer punctuation cut) has the sum of four hashed embeddings: of the whole word and of its
first four, six and eight bytes, so that inflected forms share most of their vector, and a clean word shares all of
a toxic one's only by four collisions at once. Filters of several widths run over the words; each
text keeps every filter's maximum, a rectifier and a logistic layer follow. The first coordinate of an embedding
starts at the log-odds of its bucket, the rest at random. Training is minibatch descent, where the maximum sends
the gradient to one window for each text and filter. A sigmoid fitted on a fifth of the sample turns the output
into scores, and on the same fifth a threshold is chosen for each language; languages never enter a score.

Fitting uses at most `max_rows` labelled training rows (MAX_ROWS) of at most MAX_WORDS words in all (8 bytes each on the driver), half of them of each label where there are as many,
the first by a hash of their id; the sigmoid is shifted back to the labels' true shares. Scoring is
one pass over all documents, whole texts, with memory bounded by a block of texts.

Cases: null and empty texts keep the filters' floor of zero, so all of them have one score; texts shorter than
a filter are padded with zero vectors; without rows of both classes every score is the share of label 1 (0.5
without any); null or unseen languages have the general threshold; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweft.llm._common import bounded, crc_mod, hash_sample, held, mapped, text_runs
from tokenweft.llm.classifier import FOLDS, HELD_OUT, sigmoid_fit, training_ids
from tokenweft.llm.words import words

BITS, DIM, WIDTHS, FILTERS, PARTS = 16, 12, (1, 2, 3), 12, 4
MAX_ROWS, MAX_WORDS = 8_000, 8_000_000
THRESHOLD = 0.5
#: Fixed value: what is cut from both ends of a word.
OUTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Buckets(dict):
    """word -> its PARTS embedding rows, packed in one number; emptied between blocks once it holds `most` words."""

    def __init__(self, bits: int, most: int = 500_000):
        super().__init__()
        self.bits, self.most = bits, most

    def __missing__(self, word: bytes) -> int:
        core = word.strip(OUTER).lower()
        value = 0
        for k, part in enumerate((core, core[:4], core[:6], core[:8])):
            value |= (xxhash.xxh64_intdigest(part, k) >> (64 - self.bits)) << (self.bits * k)
        self[word] = value
        return value

    def packed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The packed rows of all texts' words, and the texts' numbers of words."""
        if len(self) > self.most:
            self.clear()
        found = [words(t) for t in texts]
        counts = np.array([len(w) for w in found], np.int64)
        return np.fromiter(map(self.__getitem__, (w for ws in found for w in ws)), np.uint64, int(counts.sum())), counts

    def rows_of(self, packed: np.ndarray) -> np.ndarray:
        """(PARTS, words): the embedding rows."""
        return np.stack([((packed >> np.uint64(self.bits * k)) & np.uint64((1 << self.bits) - 1)).astype(np.int32) + (k << self.bits) for k in range(PARTS)])

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        packed, counts = self.packed(texts)
        return self.rows_of(packed), counts


@dataclass
class Model:
    bits: int
    embedding: np.ndarray  # (PARTS * 2**bits, dim)
    filters: dict[int, np.ndarray]  # width -> (width * dim, number)
    shift: np.ndarray
    out: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def constant(cls, share: float, bits: int) -> Model:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return cls(bits, np.zeros((PARTS << bits, 1), np.float32), {1: np.zeros((1, 1), np.float32)}, np.zeros(1, np.float32), np.zeros(1, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))

    def pooled(self, rows: np.ndarray, counts: np.ndarray, places: bool = False):
        """Maximum of every filter in every text (-inf without words), and the window it is at."""
        pad = max(self.filters) - 1
        starts = np.cumsum(counts + pad) - counts - pad
        total, n = int((counts + pad).sum()), len(counts)
        vectors = np.zeros((total + pad, self.embedding.shape[1]), np.float32)
        at = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        vectors[at] = sum(self.embedding[r] for r in rows)
        best, where = [], []
        some = np.flatnonzero(counts)
        edges = np.empty(2 * len(some), np.int64)
        edges[::2], edges[1::2] = starts[some], starts[some] + counts[some]
        for width, weight in self.filters.items():
            dim = vectors.shape[1]
            z = vectors[:total] @ weight[:dim]
            for j in range(1, width):
                z += vectors[j : total + j] @ weight[j * dim : (j + 1) * dim]
            top = np.full((n, z.shape[1]), -np.inf, np.float32)
            if len(some):
                z = np.vstack([z, np.full((1, z.shape[1]), -np.inf, np.float32)])
                top[some] = np.maximum.reduceat(z, edges, axis=0)[::2]
            best.append(top)
            if places:
                where.append(np.stack([z[s : s + c].argmax(0) + s if c else np.full(z.shape[1], -1) for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]))
        return (np.hstack(best), where, vectors, at) if places else np.hstack(best)

    def raw(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, counts) + self.shift, 0) @ self.out + self.bias

    def scores(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(rows, counts).astype(float) + self.b, -35, 35)))


def log_odds(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    seen = np.zeros((2, size))
    for r, label in zip(rows, y, strict=True):
        seen[label][np.unique(r)] += 1
    n = np.array([(y == k).sum() for k in (0, 1)])
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return np.where(seen.sum(0) > 1, np.clip(odds, -3, 3), 0.0)


def train(rows: list[np.ndarray], y: np.ndarray, langs: list[str | None], bits: int = BITS, epochs: int = 8, batch: int = 32, seed: int = 5, prior: float | None = None) -> Model:
    """rows: (PARTS, words) embedding rows of each text; y: 0 or 1; prior: the share of 1 outside the sample."""
    if not len(y) or y.min() == y.max():
        return Model.constant(float(y.mean()) if len(y) else 0.5, bits)
    rng = np.random.default_rng(seed)
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    learn, check = np.flatnonzero(~apart), np.flatnonzero(apart) if apart.any() else np.arange(len(y))
    embedding = rng.normal(0, 0.05, (PARTS << bits, DIM)).astype(np.float32)
    embedding[:, 0] = 0.25 * log_odds([rows[i] for i in learn], y[learn], PARTS << bits)
    filters = {w: rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for f in filters.values():
        f[0] = np.abs(f[0]) + 0.5  # begin by looking at the log-odds
    k = FILTERS * len(WIDTHS)
    model = Model(bits, embedding, filters, np.zeros(k, np.float32), np.full(k, 1.0 / k, np.float32), -1.0)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    memory: dict = {}

    def step(name, value: np.ndarray, grad: np.ndarray, rate: float, at=None) -> None:
        """A step scaled by the root of the summed squares so far."""
        total = memory.setdefault(name, np.full(value.shape, 1e-4, np.float32))
        if at is None:
            total += grad * grad
            value -= rate * grad / np.sqrt(total)
        else:
            total[at] += grad * grad
            value[at] -= rate * grad / np.sqrt(total[at])

    bias = np.array([model.bias], np.float32)
    for _ in range(epochs):
        order = rng.permutation(learn)
        for s in range(0, len(order), batch):
            ids = order[s : s + batch]
            some = np.concatenate([rows[i] for i in ids], axis=1)
            counts = np.array([rows[i].shape[1] for i in ids])
            top, where, vectors, at = model.pooled(some, counts, True)
            act = top + model.shift
            hidden = np.maximum(act, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + bias[0], -30, 30)))
            d = ((p - y[ids]) * weight[ids] / len(ids)).astype(np.float32)
            dh = np.where(act > 0, d[:, None] * model.out, 0).astype(np.float32)
            out_grad, shift_grad = hidden.T @ d + 1e-4 * model.out, dh.sum(0)
            words_grad = np.zeros_like(vectors)
            for g, width in enumerate(model.filters):
                span = slice(g * FILTERS, (g + 1) * FILTERS)
                pos, grad = where[g], dh[:, span]
                live = np.nonzero(grad)
                places, f, value = pos[live], live[1], grad[live]
                kernel = model.filters[width]
                change = np.zeros_like(kernel)
                for j in range(width):
                    part = slice(j * DIM, (j + 1) * DIM)
                    change[part] = vectors[places + j].T @ (value[:, None] * (f[:, None] == np.arange(FILTERS)))
                    np.add.at(words_grad, places + j, value[:, None] * kernel[part].T[f])
                step(width, kernel, change, 0.05)
            step("out", model.out, out_grad, 0.05)
            step("shift", model.shift, shift_grad, 0.05)
            step("bias", bias, np.array([d.sum()], np.float32), 0.05)
            touched = words_grad[at]
            live = np.flatnonzero(np.abs(touched).sum(1))
            for h in range(PARTS):
                ids_h, back = np.unique(some[h][live], return_inverse=True)
                grad = np.zeros((len(ids_h), DIM), np.float32)
                np.add.at(grad, back, touched[live])
                step("words", embedding, grad, 0.05, ids_h)
    model.bias = float(bias[0])
    margins = np.concatenate([model.raw(rows[i], np.array([rows[i].shape[1]])) for i in check]).astype(float)
    model.a, model.b = sigmoid_fit(margins, np.where(y[check] == 1, 1.0, -1.0))
    if prior is not None and 0 < prior < 1:  # the sample holds more of the rarer class than there is
        share = float(y.mean())
        model.b += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    scores = 1 / (1 + np.exp(-np.clip(model.a * margins + model.b, -35, 35)))
    model.thresholds = language_thresholds(scores, y[check], [langs[i] for i in check])
    return model


def language_thresholds(scores: np.ndarray, y: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """For each language with both labels, the middle of the cut with the best F1 (the widest gap on ties); else the general one."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        s, t = scores[mine], y[mine]
        if t.min() == t.max():
            out[lang] = THRESHOLD
            continue
        cuts = np.unique(s)
        best = (-1.0, -1.0, THRESHOLD)
        for low, high in zip(np.append(0.0, cuts), np.append(cuts, 1.0), strict=True):
            got = s >= high if high > low else s > low
            f1 = 2 * (got & (t == 1)).sum() / max(1, got.sum() + t.sum())
            best = max(best, (float(f1), float(high - low), float((low + high) / 2)))
        out[lang] = best[2]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bits: int = BITS, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    known = training_ids(labels, label)
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    ones, zeros = (hash_sample(known.where(F.col("y") == y), "doc_id", n) for y, n in ((1, max_rows // 2), (0, max_rows - max_rows // 2)))
    sample = F.broadcast(ones.unionByName(zeros))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches):
        buckets = Buckets(bits)
        for whole in batches:
            for batch in text_runs(whole):
                packed, counts = buckets.packed(batch.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(packed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("lang"), lists], names=["doc_id", "y", "lang", "words"])

    sampled = mapped(rows.join(sample, "doc_id").select("doc_id", "y", "lang", "text"), run, "doc_id long, y int, lang string, words array<long>")
    found = bounded(sampled, F.size("words"), max_rows, max_words)
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    order = order[np.random.default_rng(3).permutation(len(order))]
    lists = found["words"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]) if len(lists) else np.zeros(1, int)
    flat = lists.flatten().to_numpy().view(np.uint64) if len(lists) else np.empty(0, np.uint64)
    langs = found["lang"].to_pylist()
    texts = [Buckets(bits).rows_of(flat[ends[i] : ends[i + 1]]) for i in order]
    return train(texts, found["y"].to_numpy()[order].astype(int), [langs[i] for i in order], bits, prior=shares.get(1, 0) / max(1, sum(shares.values())))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and by the language's own threshold: lang_threshold, lang_predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found = shared.value
        buckets = held(("buckets", found.bits), lambda: Buckets(found.bits))
        for whole in batches:
            for batch in text_runs(whole, limit=1_000_000):
                got = found.scores(*buckets.of(batch.column("text").to_pylist()))
                cuts = [found.thresholds.get(x, threshold) for x in batch.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got), pa.array(cuts, pa.float64())], names=["doc_id", "score", "lang_threshold"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scored = mapped(rows, run, "doc_id long, score double, lang_threshold double")
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "lang_threshold", (F.col("score") >= F.col("lang_threshold")).cast("int").alias("lang_predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, bits: int = BITS, max_rows: int = MAX_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, label, bits, max_rows), threshold)
