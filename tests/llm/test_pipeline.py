"""The pipeline against its stages' own decisions, taken one by one."""

import corpus_pipeline
from test_pairs import classes_by_hand, fringe_rows
from tokenweft.llm import classifier, near_join, packing, quality_rules
from tokenweft.llm._common import bucket_of, hash_sample, quantiles, read
from tokenweft.llm.queries import vocabulary


def test_stages_take_effect(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    columns = docs.columns
    kept = {r["doc_id"] for r in quality_rules.rules(docs, labels).where("kept").collect()}
    scores = classifier.classify(docs, labels)
    kept &= {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    left = docs.where(docs["doc_id"].isin(sorted(kept)))
    kept = {r["doc_id"] for r in near_join.near_join(left).where("doc_id = class_id").collect()}
    want = packing.pack(docs.where(docs["doc_id"].isin(sorted(kept))), vocabulary("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    pieces = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in pieces) for r in got) == sorted(tuple(r[c] for c in pieces) for r in want.collect())
    assert len({r["sequence_id"] for r in got}) == len({r["sequence_id"] for r in want.collect()})
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "best-fit packing" and "pipeline" in corpus_pipeline.queries()


def test_near_stage_against_brute_force(spark, monkeypatch):
    """A group of near copies over the bucket limit, and pairs at its fringe: one document of each class stays."""
    rows = fringe_rows(200, 60)
    monkeypatch.setattr(near_join, "LIMIT", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, "").collect())
    assert kept == sorted(i for i, c, *_ in classes_by_hand(rows) if i == c)


def test_buckets_are_ordered(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    bounds, heavy = quantiles(df, "k", 20, 4096)
    n = df.count()
    assert len(bounds) > 20 and not heavy and quantiles(df.withColumn("k", df["k"] % 2), "k", 20, 4096)[1] == [0, 1]
    got = df.withColumn("b", bucket_of(df["k"], bounds)).collect()
    assert n == len(got) and all(r["b"] == sum(x < r["k"] for x in bounds) for r in got)


def test_hash_sample_is_that_of_a_full_sort(spark):
    from pyspark.sql import functions as F

    df = spark.range(200_000).withColumnRenamed("id", "k")
    want = [r["k"] for r in df.orderBy(F.xxhash64("k"), "k").limit(50).collect()]
    assert sorted(r["k"] for r in hash_sample(df, "k", 50).collect()) == sorted(want)
    assert hash_sample(df.limit(0), "k", 50).count() == 0 and hash_sample(df.limit(30), "k", 50).count() == 30
