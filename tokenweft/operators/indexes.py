"""Three token indexes with one interface: flat (exact), centroid (inverted lists), compressed (inverted lists and codes).

An index is an immutable snapshot of tables; add, delete and update give a new one as set operations on whole frames.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenweft.operators import compression
from tokenweft.operators.kernel import max_sim_pairs, nearest, nest, top
from tokenweft.operators.kmeans import assign, train
from tokenweft.session import cut, small
from tokenweft.sources.tables import load_snapshot, save_snapshot

DIGITS = 9


def empty_tokens(spark: SparkSession, id_type: str = "long") -> DataFrame:
    return spark.createDataFrame([], f"doc_id {id_type}, tok_pos int, embedding array<double>")


def checked(tokens: DataFrame, dim: int) -> DataFrame:
    """tokens(doc_id, tok_pos, embedding); a vector of another size stops the query that reads it."""
    fits = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size("embedding").cast("string"))).cast("array<double>"))
    return tokens.select("doc_id", "tok_pos", fits.cast("array<double>").alias("embedding"))


def ids_frame(like: DataFrame, ids: DataFrame | list) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select("doc_id").distinct()
    kind = like.schema["doc_id"].dataType.simpleString()
    return like.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {kind}").distinct()


def nearest_tokens(tokens: DataFrame, queries: DataFrame, k: int, space: str = "cosine") -> DataFrame:
    """(query_id, q_pos, weight, doc_id, tok_pos, near): the k nearest tokens of each query token, all if there are fewer; the kernel keeps k of each batch."""
    near = nearest(tokens, queries, k, space, DIGITS)
    w = Window.partitionBy("query_id", "q_pos").orderBy(F.col("near").desc(), "doc_id", "tok_pos")
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


@dataclass(frozen=True)
class FlatIndex:
    """Exact token search. max_tokens, m and ef_construction are taken for compatibility and change nothing."""

    tokens: DataFrame
    dim: int
    space: str = "cosine"

    @classmethod
    def new(cls, spark: SparkSession, dim: int, space: str = "cosine", id_type: str = "long", **ignored) -> FlatIndex:
        if space not in ("cosine", "l2"):
            raise ValueError(f"unknown space {space}")
        if ignored:
            warnings.warn(f"exact search ignores {sorted(ignored)}", stacklevel=2)
        return cls(empty_tokens(spark, id_type), dim, space)

    def add(self, tokens: DataFrame) -> FlatIndex:
        """Documents in, replacing those of the same id."""
        kept = self.delete(tokens).tokens
        return replace(self, tokens=kept.unionByName(checked(tokens, self.dim)))

    update = add

    def delete(self, ids: DataFrame | list) -> FlatIndex:
        return replace(self, tokens=self.tokens.join(ids_frame(self.tokens, ids), "doc_id", "left_anti"))

    def lookup(self, ids: DataFrame | list) -> DataFrame:
        """(doc_id, present) for the ids asked about."""
        here = self.tokens.select("doc_id").distinct().withColumn("_here", F.lit(True))
        return ids_frame(self.tokens, ids).join(here, "doc_id", "left").select("doc_id", F.coalesce("_here", F.lit(False)).alias("present"))

    def get(self, ids: DataFrame | list) -> DataFrame:
        return self.tokens.join(ids_frame(self.tokens, ids), "doc_id", "left_semi")

    def doc_ids(self) -> DataFrame:
        return self.tokens.select("doc_id").distinct()

    def stats(self) -> DataFrame:
        return self.tokens.agg(F.count_distinct("doc_id").alias("size"), F.count(F.lit(1)).alias("token_count"))

    def candidates(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, doc_id, hits): how many of the nearest tokens a document has, counted by the query tokens' weights."""
        return nearest_tokens(self.tokens, queries, k, self.space).groupBy("query_id", "doc_id").agg(F.sum("weight").alias("hits"))

    def search(self, queries: DataFrame, top_k: int = 10, candidates_per_token: int = 50, rerank: bool = True) -> DataFrame:
        found = self.candidates(queries, candidates_per_token)
        if not rerank:
            return top(found.select("query_id", "doc_id", F.col("hits").cast("double").alias("score")), top_k)
        return rescored(self.tokens, queries, found, top_k)

    def save(self, path: str) -> None:
        save_snapshot({"tokens": self.tokens}, {"kind": "flat", "dim": self.dim, "space": self.space}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlatIndex:
        tables, about = load_snapshot(spark, path)
        return cls(tables["tokens"], about["dim"], about["space"])


def rescored(tokens: DataFrame, queries: DataFrame, pairs: DataFrame, top_k: int | None) -> DataFrame:
    """The exact score of candidate (query_id, doc_id) pairs, ranked; only documents that are candidates are read further."""
    wanted = cut(pairs.select("query_id", "doc_id").distinct())
    docs = tokens.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return top(max_sim_pairs(wanted, nest(docs), queries), top_k)


def probed(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, centroid_id): the nprobe centroids nearest to any token of a query."""
    points = centroids.select(F.col("centroid_id").cast("long").alias("doc_id"), F.lit(0).alias("tok_pos"), F.col("vector").alias("embedding"))
    return nearest_tokens(points, queries, nprobe).select("query_id", F.col("doc_id").cast("int").alias("centroid_id")).distinct()


def postings_of(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """(centroid_id, doc_id): the centroids nearest to a document's tokens."""
    return assign(tokens.select("doc_id", "embedding"), centroids).select("centroid_id", "doc_id").distinct()


@dataclass(frozen=True)
class CentroidIndex:
    """Inverted lists of documents by the centroids nearest to their tokens."""

    tokens: DataFrame
    dim: int
    n_centroids: int = 1024
    centroids: DataFrame | None = None
    postings: DataFrame | None = None

    @classmethod
    def new(cls, spark: SparkSession, dim: int, n_centroids: int = 1024, id_type: str = "long") -> CentroidIndex:
        return cls(empty_tokens(spark, id_type), dim, n_centroids)

    def index_documents(self, tokens: DataFrame, centroids: DataFrame | None = None) -> CentroidIndex:
        """The first batch trains the centroids (or brings them); later ones use them."""
        rows = checked(tokens, self.dim)
        book = self.centroids if self.centroids is not None else centroids if centroids is not None else train(rows, self.n_centroids)
        base = self.delete(rows) if self.postings is not None else self
        fresh = postings_of(rows, book)
        postings = fresh if base.postings is None else base.postings.unionByName(fresh)
        return replace(base, tokens=base.tokens.unionByName(rows), centroids=book, postings=postings)

    add = update = index_documents

    def delete(self, ids: DataFrame | list) -> CentroidIndex:
        gone = ids_frame(self.tokens, ids)
        postings = self.postings if self.postings is None else self.postings.join(gone, "doc_id", "left_anti").select("centroid_id", "doc_id")
        return replace(self, tokens=self.tokens.join(gone, "doc_id", "left_anti"), postings=postings)

    lookup, get, doc_ids, stats = FlatIndex.lookup, FlatIndex.get, FlatIndex.doc_ids, FlatIndex.stats

    def candidates(self, queries: DataFrame, nprobe: int = 32) -> DataFrame:
        """(query_id, doc_id); none before training."""
        if self.postings is None:
            return queries.select("query_id").limit(0).crossJoin(self.tokens.select("doc_id").limit(0))
        return self.postings.join(small(probed(queries, self.centroids, nprobe)), "centroid_id").select("query_id", "doc_id").distinct()

    def search(self, queries: DataFrame, top_k: int = 10, nprobe: int = 32) -> DataFrame:
        return rescored(self.tokens, queries, self.candidates(queries, nprobe), top_k)

    def save(self, path: str) -> None:
        if self.postings is None:
            raise ValueError("index documents first")
        save_snapshot({"tokens": self.tokens, "centroids": self.centroids, "postings": self.postings}, {"kind": "centroid", "dim": self.dim, "n_centroids": self.n_centroids}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CentroidIndex:
        tables, about = load_snapshot(spark, path)
        return cls(tables["tokens"], about["dim"], about["n_centroids"], tables["centroids"], tables["postings"])


@dataclass(frozen=True)
class CompressedIndex:
    """Inverted lists as in CentroidIndex; vectors are kept as codes and restored for candidates only."""

    dim: int
    bits: int = 8
    n_centroids: int = 1024
    codebook_size: int = 2048
    codes: DataFrame | None = field(default=None)
    codebook: DataFrame | None = None
    centroids: DataFrame | None = None
    postings: DataFrame | None = None

    @property
    def trained(self) -> bool:
        return self.codebook is not None

    def train(self, tokens: DataFrame, codebook: DataFrame | None = None, centroids: DataFrame | None = None, retrain: bool = False) -> CompressedIndex:
        if self.trained and not retrain:
            raise ValueError("already trained; retrain=True starts anew")
        rows = checked(tokens, self.dim)
        return replace(
            self, codebook=codebook if codebook is not None else compression.train_codebook(rows, self.codebook_size),
            centroids=centroids if centroids is not None else train(rows, self.n_centroids), codes=None, postings=None,
        )

    def add(self, tokens: DataFrame) -> CompressedIndex:
        if not self.trained:
            raise ValueError("train the index before adding documents")
        rows = checked(tokens, self.dim)
        codes, fresh = compression.compress(rows, self.codebook, self.bits), postings_of(rows, self.centroids)  # lists come from the original vectors
        if self.codes is None:
            return replace(self, codes=codes, postings=fresh)
        base = self.delete(rows)
        return replace(base, codes=base.codes.unionByName(codes), postings=base.postings.unionByName(fresh))

    update = add

    def index_documents(self, tokens: DataFrame, retrain: bool = False) -> CompressedIndex:
        return self.train(tokens, retrain=retrain).add(tokens)

    def delete(self, ids: DataFrame | list) -> CompressedIndex:
        gone = ids_frame(self.codes, ids)
        return replace(self, codes=self.codes.join(gone, "doc_id", "left_anti"), postings=self.postings.join(gone, "doc_id", "left_anti").select("centroid_id", "doc_id"))

    @property
    def tokens(self) -> DataFrame:
        return self.codes

    lookup, doc_ids = FlatIndex.lookup, FlatIndex.doc_ids

    def get_compressed(self, ids: DataFrame | list) -> DataFrame:
        return self.codes.join(ids_frame(self.codes, ids), "doc_id", "left_semi")

    def get(self, ids: DataFrame | list) -> DataFrame:
        return compression.decompress(self.get_compressed(ids), self.codebook, self.bits)

    candidates = CentroidIndex.candidates

    def search(self, queries: DataFrame, top_k: int = 10, nprobe: int = 32) -> DataFrame:
        found = self.candidates(queries, nprobe)
        docs = self.codes.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
        return rescored(compression.decompress(docs, self.codebook, self.bits), queries, found, top_k)

    def stats(self) -> DataFrame:
        """doc_count, token_count, code_bytes, and ratios: of the stored codes, and the estimate at 100 tokens a document."""
        full = F.lit(4.0 * self.dim)
        stored: Column = F.sum(F.length("codes") + 2)
        rows = self.codes.agg(F.count_distinct("doc_id").alias("doc_count"), F.count(F.lit(1)).alias("token_count"), stored.alias("code_bytes"))
        estimate = F.round(F.col("doc_count") * 100 * full / F.col("code_bytes"), 2)
        return rows.select("doc_count", "token_count", "code_bytes", F.lit(self.dim).alias("dim"), F.lit(self.bits).alias("bits"), F.round(F.col("token_count") * full / F.col("code_bytes"), 2).alias("actual_ratio"), estimate.alias("estimated_ratio"))

    def save(self, path: str) -> None:
        about = {"kind": "compressed", "dim": self.dim, "bits": self.bits, "n_centroids": self.n_centroids, "codebook_size": self.codebook_size}
        save_snapshot({"codes": self.codes, "codebook": self.codebook, "centroids": self.centroids, "postings": self.postings}, about, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CompressedIndex:
        tables, about = load_snapshot(spark, path)
        return cls(about["dim"], about["bits"], about["n_centroids"], about["codebook_size"], *(tables[t] for t in ("codes", "codebook", "centroids", "postings")))
