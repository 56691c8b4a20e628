"""Search, reranking and pseudo-relevance feedback over any index; every function takes many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenweft.functions.vectors import dot, scaled
from tokenweft.operators import encode
from tokenweft.operators.kernel import max_sim, max_sim_pairs, nest, top
from tokenweft.operators.scoring import weighted
from tokenweft.session import cut, small

DIGITS = 9


def search(queries: DataFrame, encoder, index, **options) -> DataFrame:
    """(query_id, rank, doc_id, score) for queries (query_id, text)."""
    return index.search(encode.encode_queries(queries, encoder), **options)


def rerank(candidates: DataFrame, queries: DataFrame, tokens: DataFrame, top_k: int | None = None) -> DataFrame:
    """(query_id, rank, cand_pos, doc_id, score) of candidates (query_id, cand_pos, doc_id).

    A candidate without tokens keeps its place with score 0; one that is named twice is ranked twice.
    """
    candidates = cut(candidates)
    docs = tokens.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    found = candidates.join(max_sim_pairs(candidates, nest(docs), weighted(queries)), ["query_id", "doc_id"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id", "cand_pos")
    ranked = found.withColumn("rank", F.row_number().over(w))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", "cand_pos", "doc_id", "score")


def batch_rerank(candidates: DataFrame, queries: DataFrame, tokens: DataFrame, top_k: int = 10) -> DataFrame:
    return rerank(candidates, queries, tokens, top_k)


def encode_nested(texts: DataFrame, encoder) -> DataFrame:
    """(doc_id, embeddings) of (doc_id, text), for scoring alone: the vectors of a text's distinct tokens are made inside its row, so none is shuffled.

    Rows that share an id are one document: where there are any, tokens are gathered by id before they are encoded. A model's vectors are nested afterwards.
    """
    if not isinstance(encoder, encode.HashEncoder):
        return nest(encode.encode_documents(texts, encoder))
    rows = texts.select("doc_id", F.array_distinct(encode.token_array("text", "document", encoder.max_doc)).alias("tokens"))
    if not texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = rows.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return rows.select("doc_id", F.transform("tokens", lambda t: encode.hash_vector(t, encoder.dim)).alias("embeddings"))


def rerank_texts(queries: DataFrame, texts: DataFrame, encoder, top_k: int | None = None) -> DataFrame:
    """Ranks raw texts (doc_id, text) for queries (query_id, text), encoding both on the way."""
    q = encode.encode_queries(queries, encoder)
    return top(max_sim(encode_nested(texts, encoder), q, top_k), top_k)


def expansion_tokens(results: DataFrame, queries: DataFrame, tokens: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, doc_id, tok_pos, value, embedding): of the feedback documents' tokens the n best by m (1 - m), m the best similarity to the query."""
    feedback = tokens.join(small(results.select("query_id", "doc_id")), "doc_id")
    sims = feedback.join(small(queries.select("query_id", F.col("embedding").alias("_q"))), "query_id")
    m = F.round(F.max(dot("_q", "embedding")), DIGITS)
    valued = sims.groupBy("query_id", "doc_id", "tok_pos").agg(m.alias("m"), F.first("embedding").alias("embedding"))
    valued = valued.withColumn("value", F.round(F.col("m") * (1 - F.col("m")), DIGITS))
    w = Window.partitionBy("query_id").orderBy(F.col("value").desc(), "doc_id", "tok_pos")
    return valued.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select("query_id", "doc_id", "tok_pos", "value", "embedding")


def expanded(queries: DataFrame, expansion: DataFrame, weight: float = 0.5) -> DataFrame:
    """The queries with the expansion's vectors, scaled by weight and not normalised, as further tokens."""
    w = Window.partitionBy("query_id").orderBy("doc_id", "tok_pos")
    more = expansion.select("query_id", (F.lit(1_000_000) + F.row_number().over(w)).cast("int").alias("q_pos"), scaled("embedding", weight).alias("embedding"), F.lit(1.0).alias("weight"))
    own = queries.select("query_id", F.col("q_pos").cast("int").alias("q_pos"), scaled("embedding", 1.0).alias("embedding"), "weight")
    return own.unionByName(more)


def search_with_feedback(queries: DataFrame, index, tokens: DataFrame, top_k: int = 10, feedback_docs: int = 3, expansion: int = 10, weight: float = 0.5, **options) -> DataFrame:
    """A first search, an expansion from its best documents, and a second search; the expanded queries are written in between."""
    first = cut(index.search(queries, top_k=feedback_docs, **options))
    return index.search(cut(expanded(queries, expansion_tokens(first, queries, tokens, expansion), weight)), top_k=top_k, **options)
