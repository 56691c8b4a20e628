"""Residual compression: the nearest centroid of each vector and its quantised difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweft.functions.quantize import check_bits, dequantize, pack, quantize, ratio, unpack
from tokenweft.functions.vectors import minus, plus
from tokenweft.operators.kernel import best_by_token, nest
from tokenweft.operators.kmeans import assign, train
from tokenweft.session import small
from tokenweft.sources.tables import load_snapshot, save_snapshot

CENTROIDS, BITS, ITERATIONS = 2048, 8, 20


def train_codebook(vectors: DataFrame, centroids: int = CENTROIDS, iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """(centroid_id, vector): L2 centroids, not normalised."""
    return train(vectors, centroids, iterations, seed, normalize=False)


def residuals(tokens: DataFrame, codebook: DataFrame) -> DataFrame:
    """tokens plus centroid_id and residual."""
    near = assign(tokens, codebook, "l2")
    return near.join(small(codebook.select("centroid_id", F.col("vector").alias("_c"))), "centroid_id").withColumn("residual", minus("embedding", "_c")).drop("_c")


def compress(tokens: DataFrame, codebook: DataFrame, bits: int = BITS) -> DataFrame:
    """tokens with (centroid_id, dim, codes BINARY) in place of the embedding."""
    check_bits(bits)
    coded = residuals(tokens, codebook)
    return coded.withColumn("dim", F.size("embedding")).withColumn("codes", pack(quantize("residual", bits), bits)).drop("embedding", "residual")


def decompress(compressed: DataFrame, codebook: DataFrame, bits: int = BITS) -> DataFrame:
    """The vectors back, centroid plus residual, not normalised; the last dims of a padded byte are cut."""
    rows = compressed.join(small(codebook.select("centroid_id", F.col("vector").alias("_c"))), "centroid_id")
    return rows.withColumn("embedding", plus("_c", dequantize(unpack("codes", bits, F.col("dim")), bits))).drop("_c", "codes", "dim", "centroid_id")


def approximate_similarity(queries: DataFrame, compressed: DataFrame, codebook: DataFrame, bits: int = BITS) -> DataFrame:
    """(query_id, doc_id, q_pos, best): each query token's best product with the document's decompressed tokens."""
    tokens = decompress(compressed, codebook, bits)
    return best_by_token(nest(tokens), queries).select("query_id", "doc_id", "q_pos", "best")


def save_codebook(codebook: DataFrame, path: str, bits: int = BITS) -> None:
    save_snapshot({"codebook": codebook.select("centroid_id", "vector")}, {"kind": "codebook", "bits": check_bits(bits)}, path)


def load_codebook(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(codebook, bits) as they were saved; anything else that is saved there is refused."""
    tables, about = load_snapshot(spark, path)
    if about.get("kind") != "codebook":
        raise ValueError(f"{path} holds no codebook")
    return tables["codebook"], about["bits"]


def compression_ratio(dim: int, bits: int) -> float:
    return ratio(dim, bits)
