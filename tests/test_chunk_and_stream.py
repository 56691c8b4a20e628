import pytest
from helpers import rows
from hypothesis import given
from hypothesis import strategies as st

from tokenweft.operators import chunk, encode
from tokenweft.operators.indexes import CentroidIndex, CompressedIndex, FlatIndex
from tokenweft.streaming.upsert import current, delta_upsert, upsert_into


def test_short_and_empty():
    assert chunk.chunk_text("short text") == ["short text"] and chunk.chunk_text("") == chunk.chunk_text(None) == chunk.chunk_text("  \n ") == []


@given(st.text(alphabet="ab .!\n#", max_size=300), st.integers(5, 60))
def test_chunks_cover_the_text_and_keep_the_size(text, size):
    got = chunk.chunk_text(text, size, size // 4)
    assert all(0 < len(c) <= size and c in text for c in got)
    assert set("".join(got).split()) | {""} >= set() and "".join("".join(got).split()).count("a") >= text.count("a")


def test_smaller_size_gives_more_chunks():
    text = "This is a sentence about chunking. " * 30
    assert len(chunk.chunk_text(text, 100, 20)) >= len(chunk.chunk_text(text, 500, 20)) > 1
    with pytest.raises(ValueError, match="size"):
        chunk.chunk_text(text, 10, 10)


def test_markdown_cuts_at_headings():
    got = chunk.chunk_text("# One\n" + "a " * 30 + "\n# Two\n" + "b " * 30, 80, 0, "markdown")
    assert got[0].startswith("# One") and any(c.startswith("# Two") for c in got)


def test_documents_and_lookups(spark):
    docs = spark.createDataFrame([("my_doc", "x. " * 200), ("tiny", "word"), ("none", "")], "doc_id string, text string")
    got = chunk.chunk_documents(docs, 100, 10)
    assert ("tiny", 0, "tiny__chunk_0") in rows(got, "doc_id", "chunk_index", "chunk_id") and got.where("doc_id = 'none'").count() == 0
    assert chunk.estimate_chunks(got).where("doc_id = 'my_doc'").first()["n_chunks"] > 1
    asked = spark.createDataFrame([("tiny__chunk_0",), ("lost",)], "chunk_id string")
    assert {r["chunk_id"]: r["doc_id"] for r in chunk.doc_of(asked, got).collect()} == {"tiny__chunk_0": "tiny", "lost": None}
    assert chunk.chunks_of(spark.createDataFrame([("tiny",), ("unknown",)], "doc_id string"), got).count() == 1


@pytest.mark.parametrize(("how", "want"), [("max", 20.0), ("mean", 15.0), ("sum", 30.0)])
def test_merge(spark, how, want):
    mapping = spark.createDataFrame([("d1__chunk_0", "d1"), ("d1__chunk_1", "d1")], "chunk_id string, doc_id string")
    results = spark.createDataFrame([(0, "d1__chunk_0", 10.0), (0, "d1__chunk_1", 20.0), (0, "lone", 12.0)], "query_id long, chunk_id string, score double")
    assert rows(chunk.merge_results(results, mapping, how), "doc_id", "score") == [("d1", want), ("lone", 12.0)]
    with pytest.raises(ValueError, match="unknown"):
        chunk.merge_results(results, mapping, "median")


def test_stream_upserts_the_last_version(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "doc_id long, text string, ts long"
    encoder = encode.HashEncoder()
    for rows_ in ([(1, "old words", 1), (2, "other", 1)], [(1, "new", 2), (1, "newest text here", 3)]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(upsert_into(str(tmp_path / "index"), encoder))
        q = stream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    first, second = (FlatIndex.load(spark, str(tmp_path / "index" / n)).tokens for n in ("0", "1"))
    assert first.where("doc_id = 1").count() == 5 and second.where("doc_id = 1").count() == 6 and second.where("doc_id = 2").count() == 4
    upsert_into(str(tmp_path / "index"), encoder)(spark.createDataFrame([(9, "again", 9)], schema), 1)  # a repeated batch changes nothing
    assert FlatIndex.load(spark, str(tmp_path / "index/1")).tokens.where("doc_id = 9").count() == 0


@pytest.mark.parametrize("kind", ["flat", "centroid", "compressed"])
def test_deltas_give_the_same_index_as_one_snapshot(spark, tmp_path, kind):
    path, schema, encoder = str(tmp_path / "index"), "doc_id long, text string, ts long", encode.HashEncoder()
    batches = [[(1, "cats chase mice", 1), (2, "dogs bark", 1)], [(1, "spark joins", 2), (1, "spark joins tables", 3)], [], [(3, "birds sing", 4)], [(2, "dogs sleep", 5), (4, None, 5)]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    first = encode.encode_documents(frames[0], encoder).select("doc_id", "tok_pos", "embedding")
    start = {"flat": None, "centroid": CentroidIndex.new(spark, encoder.dim, 3), "compressed": CompressedIndex(encoder.dim, 8, 3, 4).train(first)}[kind]
    run = delta_upsert(path, encoder, start, every=2)
    for n, frame in enumerate(frames):
        run(frame, n)
        run(frame, n)  # a repeated batch
    assert {p.name for p in (tmp_path / "index").iterdir()} == {"2", "3-delta", "4-delta", "4"}
    got = current(spark, path)
    assert {(r["doc_id"], r["n"]) for r in got.tokens.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == {(1, 6), (2, 5), (3, 5), (4, 3)}
    queries = encode.encode_queries(spark.createDataFrame([(1, "spark tables"), (2, "dogs sleep"), (3, "mice")], "query_id long, text string"), encoder)
    options = {} if kind == "flat" else {"nprobe": 3}
    top1 = {r["query_id"]: r["doc_id"] for r in got.search(queries, 1, **options).collect()}
    assert top1[1] == 1 and top1[2] == 2
    if kind != "flat":
        assert {r["doc_id"] for r in got.postings.select("doc_id").collect()} == {1, 2, 3, 4} and got.postings.distinct().count() == got.postings.count()
    with pytest.raises(ValueError, match="no snapshot"):
        current(spark, str(tmp_path / "none"))
