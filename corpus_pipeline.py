"""From raw documents to packed training sequences: quality rules, quality classifier, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.

Cases: null and empty texts fail the base rules of the first stage; rows that share a doc_id are judged by their own texts; an empty
table, or one of which a stage leaves nothing, gives an empty result; further columns of documents pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenweft.llm import classifier, near_join, packing, quality_rules
from tokenweft.llm._common import read, stored
from tokenweft.llm.queries import vocabulary


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that fail a base rule or the likelihood ratio go."""
    return quality_rules.keep(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, fitted on labelled rows of the raw documents (the rules have removed most of one class here): rejected ones go."""
    model = classifier.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return classifier.keep(docs, model)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the document with the least doc_id of each class stays."""
    return near_join.keep_one(docs, near_join.classes(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces and their places in sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules_stage), ("quality classifier", classifier_stage), ("n-gram Jaccard join", near_stage), ("best-fit packing", packing_stage),
]

#: Models, similarity classes and tokenisation are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
