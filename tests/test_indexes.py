import math

import numpy as np
import pytest
from helpers import queries, ranked, rows, tokens

from tokenweft.functions.quantize import dequantize, pack, quantize, ratio, unpack
from tokenweft.operators import compression, kmeans, retrieve
from tokenweft.operators.indexes import CentroidIndex, CompressedIndex, FlatIndex


def flat(spark, docs=None):
    index = FlatIndex.new(spark, 4, id_type="string")
    return index.add(tokens(spark, docs)) if docs else index


DOCS = {"doc1": [(1, 0, 0, 0), (0.9, 0.1, 0, 0)], "doc2": [(0, 1, 0, 0), (0, 0.9, 0.1, 0)]}


def sizes(index):
    r = index.stats().first()
    return r["size"], r["token_count"]


def test_life_cycle(spark, tmp_path):
    assert sizes(flat(spark)) == (0, 0)
    index = flat(spark, DOCS)
    assert sizes(index) == (2, 4)
    near = index.candidates(queries(spark, {0: [(0.95, 0.05, 0, 0)]}), 5)
    assert "doc1" in {r["doc_id"] for r in near.collect()}
    less = index.delete(["doc1", "nowhere"])
    assert sizes(less) == (1, 2) and rows(less.lookup(["doc1", "doc2"]), "doc_id", "present") == [("doc1", False), ("doc2", True)]
    assert sizes(index) == (2, 4)  # an older snapshot is as it was
    assert sizes(index.update(tokens(spark, {"doc1": [(0, 0, 1, 0)]}))) == (2, 3)
    assert sizes(flat(spark).update(tokens(spark, {"new": [(0, 0, 1, 0)]}))) == (1, 1)
    assert index.get(["nothing"]).count() == 0
    less.save(str(tmp_path / "a"))
    again = FlatIndex.load(spark, str(tmp_path / "a"))
    assert sizes(again) == (1, 2) and again.space == "cosine"


def test_wrong_dimension_is_refused(spark):
    with pytest.raises(Exception, match="expected 4 dimensions"):
        flat(spark, {"x": [(1, 0)]}).tokens.collect()


def test_retriever(spark):
    index = flat(spark, DOCS | {"doc3": [(0, 0, 1, 0)]})
    q = queries(spark, {0: [(1, 0, 0, 0)]})
    assert ranked(index.search(q, 2))[0] == "doc1" and index.search(q, 1).count() == 1
    hits = index.search(q, 3, candidates_per_token=3, rerank=False).collect()
    assert {r["doc_id"]: r["score"] for r in hits} == {"doc1": 2.0, "doc2": 1.0}
    cands = spark.createDataFrame([(0, i, d) for i, d in enumerate(["doc2", "ghost", "doc1", "doc1"])], "query_id long, cand_pos long, doc_id string")
    got = retrieve.rerank(cands, q, index.tokens)
    assert ranked(got) == ["doc1", "doc1", "doc2", "ghost"] and {r["doc_id"]: r["score"] for r in got.collect()}["ghost"] == 0.0
    assert retrieve.batch_rerank(cands, q, index.tokens, 1).count() == 1


def test_l2_space_ranks_by_distance(spark):
    docs = {"near": [(1, 0, 0, 0)], "long": [(9, 0, 0, 0)]}
    q = queries(spark, {0: [(1, 0, 0, 0)]})
    for space, want in (("cosine", "long"), ("l2", "near")):
        index = FlatIndex.new(spark, 4, space, "string").add(tokens(spark, docs))
        assert {r["doc_id"] for r in index.candidates(q, 1).collect()} == {want}


def unit(rng, *shape):
    v = rng.normal(size=shape)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def test_centroid_index_properties(spark, tmp_path):
    rng = np.random.default_rng(3)
    docs = {i: unit(rng, 8, 16) for i in range(20)}
    q = queries(spark, {i: docs[i][:4] for i in range(3)})
    index = CentroidIndex.new(spark, 16, 8).index_documents(tokens(spark, docs))
    exact = FlatIndex.new(spark, 16).add(tokens(spark, docs)).search(q, 1, 1000)
    best = {r["query_id"]: r["doc_id"] for r in exact.collect()}
    got = index.search(q, 5, nprobe=8)
    assert {r["query_id"]: r["doc_id"] for r in got.where("rank = 1").collect()} == best
    counts = [index.candidates(q, n).count() for n in (1, 2, 4, 8)]
    assert counts == sorted(counts) and counts[-1] == 60
    assert index.delete([0]).postings.where("doc_id = 0").count() == 0
    assert CentroidIndex.new(spark, 16).search(q).count() == 0
    index.save(str(tmp_path / "c"))
    assert rows(CentroidIndex.load(spark, str(tmp_path / "c")).search(q, 5, 8), "query_id", "rank", "doc_id", "score") == rows(got, "query_id", "rank", "doc_id", "score")


def test_compressed_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    docs = {i: unit(rng, 6, 32) for i in range(10)}
    data, q = tokens(spark, docs), queries(spark, {0: docs[4]})
    new = CompressedIndex(32, 8, 4, 16)
    with pytest.raises(ValueError, match="train"):
        new.add(data)
    index = new.index_documents(data)
    with pytest.raises(ValueError, match="already"):
        index.index_documents(data)
    assert ranked(index.search(q, 3, nprobe=4))[0] == 4
    back = {(r["doc_id"], r["tok_pos"]): np.array(r["embedding"]) for r in index.get(list(docs)).collect()}
    assert min(float(back[d, i] @ v / np.linalg.norm(back[d, i])) for d, vs in docs.items() for i, v in enumerate(vs)) > 0.9
    stats = index.stats().first()
    assert stats["doc_count"] == 10 and stats["token_count"] == 60 and stats["actual_ratio"] == round(128 / 34, 2)
    assert index.delete([4]).doc_ids().count() == 9
    assert sizes_of(index.update(tokens(spark, {4: docs[4][:2]}))) == 56
    index.save(str(tmp_path / "z"))
    assert ranked(CompressedIndex.load(spark, str(tmp_path / "z")).search(q, 3, nprobe=4)) == ranked(index.search(q, 3, nprobe=4))


def sizes_of(index):
    return index.codes.count()


def test_ratios():
    assert [ratio(128, b) for b in (1, 2, 4, 8)] == [28.44, 15.06, 7.76, 3.94]
    with pytest.raises(ValueError, match="bits"):
        ratio(128, 3)


@pytest.mark.parametrize(("bits", "codes", "want"), [(1, [1, 0, 1, 0, 1, 0, 1, 0], 170), (1, [1] * 8, 255), (1, [0] * 8, 0), (1, [1, 1, 0, 0, 1, 1, 0, 0], 204), (2, [0, 1, 2, 3], 27), (2, [1, 2, 1, 2], 102), (4, [1, 15], 31), (8, [200], 200)])
def test_packing(spark, bits, codes, want):
    df = spark.createDataFrame([(codes,)], "c array<int>").select(pack("c", bits).alias("p")).select("p", unpack("p", bits, len(codes)).alias("u"))
    assert list(df.first()["p"]) == [want] and df.first()["u"] == codes


@pytest.mark.parametrize(("bits", "limit"), [(8, 1e-4), (4, 0.01), (2, 0.2), (1, 1.0)])
def test_quantisation_error(spark, bits, limit):
    v = np.random.default_rng(bits).uniform(-1, 1, 33)
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(dequantize(unpack(pack(quantize("v", bits), bits), bits, 33), bits).alias("b"))
    assert np.mean((np.array(df.first()["b"]) - v) ** 2) < limit


def test_round_trip_through_the_codebook(spark):
    rng = np.random.default_rng(8)
    data = tokens(spark, {i: unit(rng, 4, 20) for i in range(5)})
    book = compression.train_codebook(data, 8)
    for bits, limit in ((8, 0.01), (2, 1.5), (1, 2.0)):
        back = compression.decompress(compression.compress(data, book, bits), book, bits)
        both = data.join(back.withColumnRenamed("embedding", "b"), ["doc_id", "tok_pos"]).collect()
        assert np.mean([np.sum((np.array(r["embedding"]) - np.array(r["b"])) ** 2) / 20 for r in both]) < limit
    assert compression.approximate_similarity(queries(spark, {0: unit(rng, 5, 20)}), compression.compress(data, book), book).count() == 25


def test_kmeans(spark):
    data = tokens(spark, {0: [(0, 0), (0, 0.2)], 1: [(10, 10), (10, 10.2)]})
    start = spark.createDataFrame([(0, [0.0, 1.0]), (1, [9.0, 9.0]), (2, [99.0, 99.0])], "centroid_id int, vector array<double>")
    got = {r["centroid_id"]: r["vector"] for r in kmeans.lloyd(data, start, 3).collect()}
    assert got[0] == pytest.approx([0, 0.1]) and got[1] == pytest.approx([10, 10.1]) and got[2] == [99.0, 99.0]
    assert kmeans.train(data, 9, normalize=False).count() <= 4
    norms = [math.hypot(*r["vector"]) for r in kmeans.normalized(start).collect()]
    assert norms == pytest.approx([1, 1, 1])
    ties = spark.createDataFrame([(4, [1.0, 0.0]), (2, [1.0, 0.0])], "centroid_id int, vector array<double>")
    assert {r["centroid_id"] for r in kmeans.assign(data, ties).collect()} == {2}


def test_feedback(spark):
    docs = {"doc1": [(1, 0, 0, 0), (0.8, 0.2, 0, 0)], "doc2": [(0, 1, 0, 0), (0, 0.8, 0.2, 0)]}
    index, q = flat(spark, docs), queries(spark, {0: [(0.9, 0.1, 0, 0)]})
    results = index.search(q, 2)
    expansion = retrieve.expansion_tokens(results, q, index.tokens, 2)
    assert expansion.count() == 2
    by_hand = {(d, i): round(m * (1 - m), 9) for d, vs in docs.items() for i, v in enumerate(vs) for m in [sum(a * b for a, b in zip((0.9, 0.1, 0, 0), v, strict=True))]}
    assert [r["value"] for r in expansion.orderBy("value", ascending=False).collect()] == sorted(by_hand.values(), reverse=True)[:2]
    assert retrieve.expansion_tokens(results.limit(0), q, index.tokens, 2).count() == 0
    more = retrieve.expanded(q, expansion, 0.5).orderBy("q_pos").collect()
    assert len(more) == 3 and max(np.linalg.norm(r["embedding"]) for r in more[1:]) <= 0.5
    assert retrieve.search_with_feedback(q, index, index.tokens, 2).count() == 2


def test_training_on_repeated_vectors(spark):
    same = tokens(spark, {i: [(1, 0, 0)] * 9 + [(0, 1, 0)] * 5 + [(0, 0, 1)] for i in range(20)})
    for k, seed in [(2, 1), (3, 2), (3, 3), (8, 4)]:
        got = [tuple(r["vector"]) for r in kmeans.train(same, k, seed=seed).collect()]
        assert len(got) == min(k, 3) and (k == 2 or {tuple(round(x, 6) + 0.0 for x in v) for v in got} == {(1, 0, 0), (0, 1, 0), (0, 0, 1)})
