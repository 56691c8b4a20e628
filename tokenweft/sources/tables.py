"""Reading tables, and index snapshots: data first, the description last, so that a snapshot is there wholly or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_table(vectors: DataFrame, per_document: int = 5) -> DataFrame:
    """(doc_id, tok_pos, embedding): consecutive vectors read as the tokens of documents of a fixed length."""
    return vectors.select((F.col("vec_id") / per_document).cast("long").alias("doc_id"), (F.col("vec_id") % per_document).cast("int").alias("tok_pos"), "embedding")


def query_table(tokens: DataFrame, every: int = 50) -> DataFrame:
    """The documents whose id is divisible by `every` as queries: (query_id, q_pos, embedding, weight)."""
    return tokens.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), F.col("tok_pos").alias("q_pos"), "embedding", F.lit(1.0).alias("weight"))


def save_snapshot(tables: dict[str, DataFrame], about: dict, path: str) -> None:
    """Parquet tables below path, then _about with their names and the settings."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(about | {"tables": sorted(tables)}, sort_keys=True),)], "about string").coalesce(1).write.parquet(f"{path}/_about")


def load_snapshot(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    about = json.loads(spark.read.schema("about string").parquet(f"{path}/_about").first()["about"])
    return {name: spark.read.parquet(f"{path}/{name}") for name in about.pop("tables")}, about
