"""Quality rules, classifiers and the language model against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from tokenweft.llm import classifier, language_model, quality_rules, toxicity
from tokenweft.llm.words import Block, WordTable, shape


def key(i):
    return -1 if i is None else i


def by_hand(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    repeated = sum(1 for n, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:n])
    windows = collections.Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    cover = {i + j for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for j in range(3)}
    n = len(found)
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_base_rules(docs, rows, labels, nothing):
    got = quality_rules.rules(docs, labels).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    long = 10_000  # the quadratic count of lines is for short texts
    want = sorted((key(i), *by_hand(t)) for i, t, _ in rows if len(t or "") < long)
    some = {i for i, t, _ in rows if len(t or "") >= long}
    assert sorted((key(r["doc_id"]), *(r[c] for c in columns)) for r in got if r["doc_id"] not in some) == want
    assert len(got) == len(rows) and not any(r["kept"] and r["base_failed"] for r in got)
    assert all(not r["kept"] for r in got if r["doc_id"] is not None and 60 <= r["doc_id"] < 68)
    clean = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 40 and not r["base_failed"]]
    assert clean and all(r["kept"] for r in clean)
    assert quality_rules.rules(nothing, labels).count() == 0


def test_ratio_by_hand(docs, rows, labels):
    ratios = quality_rules.fit(docs, labels, bits=8)
    table = WordTable(True)
    raw, target = np.zeros(256), np.zeros(256)
    good = {r["doc_id"] for r in labels.where("quality = 1 and doc_id is not null").collect()}
    for i, t, _ in rows:
        b, _ = Block(table, [t]).features(8)
        raw += np.bincount(b, minlength=256)
        if i in good:
            target += np.bincount(b, minlength=256)
    assert ratios == pytest.approx(np.log((target + 0.5) / (target.sum() + 128)) - np.log((raw + 0.5) / (raw.sum() + 128)), abs=1e-5)


def test_every_trusted_document_counts(spark, docs, labels):
    many = spark.range(20_500).selectExpr("id as doc_id", "concat('w', id, ' x') as text")
    assert not quality_rules.fit(many, many.selectExpr("doc_id", "1 as quality"), bits=8).any()  # the target is the raw corpus
    assert (quality_rules.fit(docs, labels, bits=8) == quality_rules.fit(docs, labels, bits=8, max_shipped=0)).all()


def test_no_trusted_rows_leave_base_rules_alone(docs, labels):
    got = quality_rules.rules(docs, labels.limit(0)).collect()
    assert all(r["llr"] == 0 and r["kept"] != r["base_failed"] for r in got)


def test_blocks_do_not_cross_texts():
    table = WordTable(True)
    texts = ["a b c", None, "c d", "", "e e e e"]
    together = Block(table, texts)
    b, d = together.features(20)
    for k, t in enumerate(texts):
        assert sorted(b[d == k]) == sorted(Block(table, [t]).features(20)[0])
    assert shape(b"Hello,42!x") == b"Aa,0!a" and shape("éa".encode()) == b"a"


@pytest.mark.parametrize(("module", "label", "threshold"), [(classifier, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers(docs, rows, labels, nothing, module, label, threshold):
    got = module.classify(docs, labels).collect()
    truth = {r["doc_id"]: r[label] for r in labels.where(f"{label} is not null and doc_id is not null").collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    known = [r for r in got if r["doc_id"] in truth and r["doc_id"] != 10]
    ones, zeros = ([r["score"] for r in known if truth[r["doc_id"]] == k] for k in (1, 0))
    better = np.mean([[a > b for b in zeros] for a in ones])
    assert better > 0.9
    by_text = collections.defaultdict(set)
    texts = {i: t for i, t, _ in rows if i is not None and i != 10}
    for r in got:
        if r["doc_id"] in texts:
            by_text[texts[r["doc_id"]] or ""].add(round(r["score"], 6))
    assert all(len(s) == 1 for s in by_text.values())  # equal texts, equal scores; null is empty
    assert module.classify(nothing, labels).count() == 0
    none = module.classify(docs, labels.limit(0)).collect()
    assert all(r["score"] == pytest.approx(0.5) for r in none)


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.where([3 in r or 7 in r for r in rows], 1.0, -1.0)
    r, c = np.ones(30), np.full(60, 1.0)
    w = classifier.dual_coordinate_descent(rows, y, r, c, epochs=300)
    x = np.zeros((60, 31))
    for i, f in enumerate(rows):
        x[i, f] = 1
        x[i, 30] = 1
        x[i] /= np.linalg.norm(x[i])

    def loss(v):
        return 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()

    assert all(loss(w) <= loss(w + rng.normal(0, s, 31)) + 1e-3 for s in (0.01, 0.1, 1.0) for _ in range(30))


def test_pooling_by_hand():
    rng = np.random.default_rng(0)
    buckets = toxicity.Buckets(10)
    model = toxicity.Model(10, rng.normal(size=(toxicity.PARTS << 10, 4)).astype("f4"), {w: rng.normal(size=(w * 4, 2)).astype("f4") for w in (1, 2, 3)}, np.zeros(6, "f4"), np.ones(6, "f4"), 0.0)
    texts = ["one two three four", None, "single", "a b"]
    rows, counts = buckets.of(texts)
    got = model.pooled(rows, counts)
    at = 0
    for k, n in enumerate(counts):
        v = sum(model.embedding[r[at : at + n]] for r in rows)
        padded = np.vstack([v.reshape(n, 4), np.zeros((2, 4))])
        want = [max(((padded[i : i + w].ravel() @ f)[c] for i in range(n)), default=-np.inf) for w, f in model.filters.items() for c in range(2)]
        assert got[k] == pytest.approx(want, abs=1e-4)
        at += n


def test_language_model(docs, rows, nothing):
    got = language_model.score(docs).collect()
    def tokens(t):
        return [*(t or "").encode().lower().split(), b"\0end"]
    def fold(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 7
    uni, bi, kept_uni, kept_bi = (collections.Counter() for _ in range(4))
    for i, t, _ in rows:
        if fold(i) != 2:
            w = tokens(t)
            for u, b in ((uni, bi), *(((kept_uni, kept_bi),) if fold(i) != 3 else ())):
                u.update(w)
                b.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)
    want = sorted((key(i), fold(i) == 2, len(tokens(t)), sum(w in uni for w in tokens(t)), n, round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t, _ in rows)
    assert sorted((key(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    # the same mixture by hand, with weights from the same histogram
    total, distinct = sum(kept_uni.values()), len(kept_uni)
    events = []
    for i, t, _ in rows:
        if fold(i) == 3:
            w = tokens(t)
            for a, b in zip([None, *w], w):
                context = kept_uni[b"\0end"] if a is None else kept_uni[a]
                events.append((context, kept_bi[a, b] / context if context else 0.0, kept_uni[b] / total))
    q = language_model.frequency_bucket(np.array([e[0] for e in events]))
    weights = np.tile(language_model.DEFAULT, (language_model.BUCKETS, 1))
    cells = q * language_model.BINS1 * language_model.BINS2 + np.arange(len(q)) % 1
    exact = language_model.mixture(cells, np.ones(len(q)), np.array([e[1] for e in events]), np.array([e[2] for e in events]), 1 / (distinct + 1))
    assert exact.shape == weights.shape and np.allclose(exact.sum(1), 1)
    scores = {key(r["doc_id"]): r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] != 10}
    for i, t, _ in rows:
        if i is None or i == 10:
            continue
        w = tokens(t)
        s = 0.0
        for a, b in zip([None, *w], w):
            context = uni[b"\0end"] if a is None else uni[a]
            l0, l1, l2 = exact[language_model.frequency_bucket(np.array([context]))[0]]
            s += math.log10(l0 / (v + 1) + l1 * uni[b] / n + (l2 * bi[a, b] / context if context else 0))
        assert scores[i] == pytest.approx(s, rel=0.05, abs=0.5)  # cells of the histogram are coarse on so few events
    assert language_model.score(nothing).count() == 0


def test_count_packing():
    for v in ([], [0, 1, 254, 255, 256, 2**33], [3] * 1000):
        assert language_model.unpack_counts(language_model.pack_counts(np.array(v, np.int64))).tolist() == v
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 77, dtype=np.uint64))
    assert np.array_equal(language_model.unpack_keys(language_model.pack_keys(keys)), keys)


def test_every_language_has_a_threshold():
    names = [f"l{i:03}" for i in range(300)]
    found = toxicity.language_thresholds(np.tile([0.1, 0.3], 300), np.tile([0, 1], 300), [x for x in names for _ in range(2)])
    assert sorted(found) == names and max(abs(v - 0.2) for v in found.values()) < 1e-12


def test_driver_takes_whole_ids_within_bounds(spark):
    from pyspark.sql import functions as F

    from tokenweft.llm._common import bounded

    df = spark.createDataFrame([(i // 3 if i < 30 else i, [1] * 10) for i in range(90)], "doc_id long, words array<int>").repartition(4)
    take = lambda rows, size: bounded(df, F.size("words"), rows, size).column("doc_id").to_pylist()
    assert len(take(90, 900)) == 90 and len(take(1000, 10_000)) == 90
    for rows, size in ((20, 900), (90, 200), (1, 900)):
        got = collections.Counter(take(rows, size))
        assert sum(got.values()) <= min(rows, size // 10) and all(n == (3 if i < 10 else 1) for i, n in got.items())
    assert sum(collections.Counter(take(20, 900)).values()) >= 18 and bounded(df.limit(0), F.size("words"), 5, 5).num_rows == 0
