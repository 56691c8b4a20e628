"""The short way in: encode, index, search, rerank, explain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenweft.operators import encode, retrieve, scoring
from tokenweft.operators.indexes import CentroidIndex, CompressedIndex, FlatIndex

KINDS = {"flat": FlatIndex, "centroid": CentroidIndex, "compressed": CompressedIndex}


def load_encoder(spark: SparkSession | None = None, model: str | None = None, **options) -> encode.HashEncoder | encode.ModelEncoder:
    """The hash encoder, or a model from its folder."""
    if model is None:
        return encode.HashEncoder(**options)
    from tokenweft.sources.models import load_model

    return load_model(spark or SparkSession.active(), model, **options)


def new_index(spark: SparkSession, encoder, kind: str = "flat", **options):
    if kind == "compressed":
        return CompressedIndex(encoder.dim, **options)
    return KINDS[kind].new(spark, encoder.dim, **options)


def index(docs: DataFrame, encoder, into):
    """Documents (doc_id, text) into an index of any kind."""
    tokens = encode.encode_documents(docs, encoder).select("doc_id", "tok_pos", "embedding")
    if isinstance(into, CompressedIndex) and not into.trained:
        return into.index_documents(tokens)
    return into.add(tokens)


search = retrieve.search
rerank_texts = retrieve.rerank_texts


def rerank(queries: DataFrame, candidates: DataFrame, encoder, of, top_k: int | None = None) -> DataFrame:
    """Candidates (query_id, cand_pos, doc_id) of an index for queries (query_id, text)."""
    return retrieve.rerank(candidates, encode.encode_queries(queries, encoder), of.get(candidates), top_k)


def search_with_feedback(queries: DataFrame, encoder, of, **options) -> DataFrame:
    return retrieve.search_with_feedback(encode.encode_queries(queries, encoder), of, of.get(of.doc_ids()), **options)


def explain(queries: DataFrame, docs: DataFrame, encoder) -> DataFrame:
    """Matches of the queries' tokens in the documents (query_id, text) and (doc_id, text)."""
    q, d = encode.encode_queries(queries, encoder), encode.encode_documents(docs, encoder)
    return scoring.explain(q, d, q.where(q["token"] != encode.MASK), d)


def save(of, path: str) -> None:
    of.save(path)


def load(spark: SparkSession, path: str):
    """An index of the kind that was saved."""
    import json

    about = json.loads(spark.read.schema("about string").parquet(f"{path}/_about").first()["about"])
    return KINDS[about["kind"]].load(spark, path)
