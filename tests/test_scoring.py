import numpy as np
import pytest
from helpers import queries, ranked, rows, tokens

from tokenweft.operators import scoring
from tokenweft.operators.kernel import max_sim, nest, top

CASES = [
    ([(1, 0, 0), (0, 1, 0)], [(1, 0, 0), (0, 1, 0)], 2.0),
    ([(1, 0, 0)], [(0, 1, 0)], 0.0),
    ([(1, 0, 0), (0, 1, 0)], [(1, 0, 0), (0, 1, 0), (0.5, 0.5, 0)], 2.0),
    ([(0.6, 0.8, 0)], [(0.6, 0.8, 0), (1, 0, 0)], 1.0),
    ([(1, 0, 0, 0), (0, 1, 0, 0)], [(1, 0, 0, 0), (0, 0.5, 0.5, 0), (0, 0, 1, 0)], 1.5),
]


@pytest.mark.parametrize(("q", "d", "want"), CASES)
def test_max_sim_both_ways(spark, q, d, want):
    qs, ts = queries(spark, {0: q}), tokens(spark, {7: d})
    assert scoring.scores(qs, ts).first()["score"] == pytest.approx(want)
    assert max_sim(nest(ts), qs).first()["score"] == pytest.approx(want)


def test_kernel_agrees_with_joins_and_numpy(spark):
    rng = np.random.default_rng(1)
    q = {i: rng.normal(size=(rng.integers(1, 5), 8)) for i in range(3)}
    d = {i: rng.normal(size=(rng.integers(1, 6), 8)) for i in range(20)}
    qs, ts = queries(spark, q), tokens(spark, d)
    want = {(i, j): (q[i] @ d[j].T).max(1).sum() for i in q for j in d}
    for got in (scoring.scores(qs, ts), max_sim(nest(ts), qs)):
        assert {(r["query_id"], r["doc_id"]): pytest.approx(r["score"], abs=1e-9) for r in got.collect()} == want
    best = top(max_sim(nest(ts), qs, 4), 4).collect()
    for i in q:
        assert [r["doc_id"] for r in sorted(best, key=lambda r: r["rank"]) if r["query_id"] == i] == sorted(d, key=lambda j: (-round(want[i, j], 6), j))[:4]


def test_weights_collapse_padding(spark):
    one = queries(spark, {0: [(1, 0), (0, 1), (0, 1), (0, 1)]})
    folded = spark.createDataFrame([(0, 0, [1.0, 0.0], 1.0), (0, 1, [0.0, 1.0], 3.0)], one.schema)
    ts = tokens(spark, {1: [(0.3, 0.4)], 2: [(1, 0)]})
    a, b = (dict(rows(max_sim(nest(ts), q), "doc_id", "score")) for q in (one, folded))
    assert a == pytest.approx(b)


def test_rank_and_empty(spark):
    ts = tokens(spark, {"low": [(0, 1, 0)], "high": [(1, 0, 0)], "mid": [(0.5, 0.5, 0)]})
    assert ranked(scoring.rank(queries(spark, {0: [(1, 0, 0)]}), ts)) == ["high", "mid", "low"]
    assert scoring.rank(queries(spark, {}), ts).count() == 0
    assert scoring.rank(queries(spark, {0: [(1, 0, 0)]}), ts.limit(0)).count() == 0


def results(spark, scores):
    return spark.createDataFrame([(0, f"d{i}", float(s)) for i, s in enumerate(scores)], "query_id long, doc_id string, score double")


def test_normalisation(spark):
    assert rows(scoring.normalize(results(spark, [24, 16, 8]), 32), "doc_id", "score") == [("d0", 0.75), ("d1", 0.5), ("d2", 0.25)]
    assert rows(scoring.normalize_minmax(results(spark, [30, 20, 10])), "score") == [(0.0,), (0.5,), (1.0,)]
    assert rows(scoring.normalize_minmax(results(spark, [5])), "score") == [(1.0,)]
    assert rows(scoring.normalize_minmax(results(spark, [5, 5])), "score") == [(1.0,), (1.0,)]
    assert scoring.normalize_minmax(results(spark, [])).count() == 0
    with pytest.raises(ValueError, match="positive"):
        scoring.normalize(results(spark, [1]), 0)


def test_fusion(spark):
    scored = scoring.scores(queries(spark, {0: [(1, 0, 0)], 1: [(0, 1, 0)]}), tokens(spark, {9: [(1, 0, 0)]}))
    weights = spark.createDataFrame([(0, 0.8), (1, 0.2)], "query_id long, w double")
    assert scoring.fuse(scored, "max").first()["score"] == 1.0
    assert scoring.fuse(scored, "avg").first()["score"] == 0.5
    assert scoring.fuse(scored, "weighted", weights).first()["score"] == pytest.approx(0.8)
    with pytest.raises(ValueError, match="differ"):
        scoring.fuse(scored, "weighted", weights.limit(1))
    both = tokens(spark, {"x": [(1, 0, 0)], "y": [(0, 1, 0)], "both": [(0.707, 0.707, 0)]})
    fused = scoring.fuse(scoring.scores(queries(spark, {0: [(1, 0, 0)], 1: [(0, 1, 0)]}), both), "avg")
    assert ranked(scoring.best(fused))[0] == "both"
    assert ranked(scoring.best(fused, 1)) == ["both"]


def lists(spark, *orders):
    return spark.createDataFrame([(i, r + 1, d) for i, o in enumerate(orders) for r, d in enumerate(o)], "list_id long, rank int, doc_id string")


def test_reciprocal_rank_fusion(spark):
    got = dict(rows(scoring.reciprocal_rank_fusion(lists(spark, "abc", "bac")), "doc_id", "score"))
    assert got["a"] == pytest.approx(1 / 61 + 1 / 62) == got["b"] > got["c"]
    assert dict(rows(scoring.reciprocal_rank_fusion(lists(spark, "aa")), "doc_id", "score"))["a"] == pytest.approx(1 / 61 + 1 / 62)
    assert scoring.reciprocal_rank_fusion(lists(spark)).count() == 0
    assert len(rows(scoring.reciprocal_rank_fusion(lists(spark, "ab", "cd")), "doc_id")) == 4
    low = dict(rows(scoring.reciprocal_rank_fusion(lists(spark, "abc"), 10), "doc_id", "score"))
    assert low["a"] > dict(rows(scoring.reciprocal_rank_fusion(lists(spark, "abc")), "doc_id", "score"))["a"]


def explained(spark, q, d, q_names, d_names):
    names = spark.createDataFrame(list(enumerate(q_names)), "q_pos int, token string").selectExpr("0L as query_id", "q_pos", "token")
    doc_names = spark.createDataFrame(list(enumerate(d_names)), "tok_pos int, token string").selectExpr("1L as doc_id", "tok_pos", "token")
    return scoring.explain(queries(spark, {0: q}), tokens(spark, {1: d}), names, doc_names)


def test_explain(spark):
    got = explained(spark, [(1, 0, 0), (0, 1, 0)], [(1, 0, 0), (0.5, 0.5, 0), (0, 1, 0)], ["hello", "world"], ["hello", "there"])
    found = rows(got, "query_index", "query_token", "doc_index", "doc_token", "similarity", "score")
    assert found == [(0, "hello", 0, "hello", 1.0, 2.0), (1, "world", 2, "[OUT_OF_RANGE]", 1.0, 2.0)]
    partial = explained(spark, [(1, 0), (0, 1)], [(1, 0)], ["only"], ["a"]).collect()
    assert len(partial) == 1 and partial[0]["score"] == 1.0  # the score sums rows without a name too


def test_format(spark):
    got = explained(spark, [(0.9, 0), (0.8, 0), (0.2, 0), (1, 0), (-1, 0)], [(1, 0)], ["best", "good", "weak", "[CLS]", "bad"], ["doc"])
    full = scoring.format_explanation(got).first()["report"].split("\n")
    assert full[:4] == ["Score: 1.9", "", "Query Token          -> Doc Token            Similarity", "-" * 60]
    assert full[4:] == [f"{q:20} -> {'doc':20} {s}" for q, s in (("best", "0.9"), ("good", "0.8"), ("weak", "0.2"))]
    assert len(scoring.format_explanation(got, top_k=2).first()["report"].split("\n")) == 6
    assert scoring.format_explanation(got, min_similarity=2.0).first()["report"].endswith("-" * 60 + "\n")
    assert "weak" not in scoring.format_explanation(got, min_similarity=0.5).first()["report"]
    assert "[CLS]" in scoring.format_explanation(got, skip_special=False).first()["report"]


def test_golden_score_table(spark):
    table = {0: [23.387804, 11.059401, 12.025353, 10.756254], 1: [18.75104, 12.753716, 21.674814, 19.846783], 2: [9.197324, 8.019333, 8.423847, 11.932684]}
    scored = spark.createDataFrame([(q, d, s) for q, r in table.items() for d, s in enumerate(r)], "query_id long, doc_id long, score double")
    got = top(scored, None).collect()
    order = {q: [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in table}
    assert order == {0: [0, 2, 1, 3], 1: [2, 3, 0, 1], 2: [3, 0, 2, 1]}


def test_blocks_of_queries_give_the_rows_of_one(spark, monkeypatch):
    """Queries beyond one block: scores, top ranks, candidate pairs, nearest tokens and similarities."""
    import random

    from tokenweft.operators import kernel

    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    tokens = spark.createDataFrame([(d, t, vec()) for d in range(30) for t in range(1 + d % 4)], "doc_id long, tok_pos int, embedding array<double>")
    queries = spark.createDataFrame([(q, t, vec(), 1.0 + t) for q in range(12) for t in range(1 + q % 3)], "query_id long, q_pos int, embedding array<double>, weight double")
    pairs = spark.createDataFrame([(q, d) for q in range(12) for d in range(q, 30, 5)] + [(99, 1), (1, 99)], "query_id long, doc_id long")
    docs = kernel.nest(tokens)

    def found():
        frames = [kernel.max_sim(docs, queries), kernel.top(kernel.max_sim(docs, queries, 3), 3), kernel.max_sim_pairs(pairs, docs, queries), kernel.nearest(tokens, queries, 100, "cosine", 9), kernel.best_by_token(docs, queries), kernel.all_pairs(tokens, queries)]
        return [sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in f.collect()) for f in frames]

    one = found()
    scores = {(q, d): s for q, d, s in one[0]}
    assert len(one[0]) == 12 * 30 and one[2] == sorted((q, d, scores[q, d]) for q in range(12) for d in range(q, 30, 5))
    monkeypatch.setattr(kernel, "QUERY_TOKENS", 5)
    assert found() == one


def test_kernel_in_pieces_gives_the_rows_of_one(monkeypatch):
    import pyarrow as pa

    from tokenweft.operators import kernel

    rng = np.random.default_rng(5)
    counts = [3, 0, 9, 1, 40, 2, 2, 7, 1, 5]
    vectors = [rng.integers(-2, 3, (n, 4)).astype(float).tolist() for n in counts]  # many ties
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i * 7 % 10}" for i in range(10)]), pa.array(vectors, pa.list_(pa.list_(pa.float64())))], names=["doc_id", "embeddings"])
    rows = [(i, j, 1.0 + j, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(6) for j in range(4)]
    q = kernel.Queries(pa.table({n: [r[k] for r in rows] for k, n in enumerate(("query_id", "q_pos", "weight", "embedding"))}))
    for top_k in (None, 3):
        seen = []
        for cells in (4_000_000, 512 * 5, 60):
            monkeypatch.setattr(kernel, "CELLS", cells)
            most, piece = [], kernel._piece
            monkeypatch.setattr(kernel, "_piece", lambda q, flat, n, most=most, piece=piece: most.append((len(flat), len(n))) or piece(q, flat, n))
            seen.append(sorted(tuple(r.values()) for b in kernel._scored(q, batch, top_k, pa.string(), 6) for r in b.to_pylist()))
            monkeypatch.setattr(kernel, "_piece", piece)
            assert all(d == 1 or t <= max(cells // 512, 1) and d * 24 <= cells for t, d in most)
        assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 6 * (top_k or 9)


def test_reports_round_as_the_sql_does(spark):
    import duckdb

    values = [k / 10**5 for k in range(5, 4_000, 10)] + [0.17325, 0.19215, 1.005, 2.675, 0.0, 0.0004]
    signed = [(i, 0, 0, "a", 0, "b", v, s * v / 7) for s in (1, -1) for i, v in enumerate(values, 1000 * s)]
    frame = spark.createDataFrame(signed, "query_id long, doc_id long, query_index int, query_token string, doc_index int, doc_token string, similarity double, score double")
    number = "CASE WHEN {v} > 0 AND {v} < 0.001 THEN round({v} * 10000)::INT || '.0e-4' ELSE {v}::VARCHAR END"
    sql = f"SELECT {number.format(v='round(?::DOUBLE, 4)')}, {number.format(v='round(?::DOUBLE, 2)')}"
    want = {i: duckdb.execute(sql, [v] * 4 + [s] * 4).fetchall()[0] for i, *_, v, s in signed}
    for r in scoring.format_explanation(frame).collect():
        lines = r["report"].split("\n")
        assert (lines[-1].split()[-1], lines[0]) == (want[r["query_id"]][0], f"Score: {want[r['query_id']][1]}")
