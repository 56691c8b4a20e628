"""A stream of documents into an index: each micro-batch is encoded and upserted, and the new snapshot is published."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenweft import api
from tokenweft.operators import encode
from tokenweft.operators.indexes import CentroidIndex, CompressedIndex, FlatIndex, empty_tokens

Index = FlatIndex | CentroidIndex | CompressedIndex
#: The tables of an index that have rows of documents; the others (centroids, codebook) are fixed once trained.
TABLES = {FlatIndex: ("tokens",), CentroidIndex: ("tokens", "postings"), CompressedIndex: ("codes", "postings")}
DELTA = "-delta"


def last_of_each(batch: DataFrame, order: str = "ts") -> DataFrame:
    """Of several rows with one doc_id the last by `order`."""
    w = Window.partitionBy("doc_id").orderBy(F.col(order).desc(), F.col("text"))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_into(path: str, encoder, order: str = "ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: reads snapshot n - 1 below path, writes snapshot n. A repeated batch writes the same snapshot."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_about/_SUCCESS"))
        if there(number):
            return
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{number}"), True)  # left by an attempt that did not end
        kind = batch.schema["doc_id"].dataType.simpleString()
        before = max((n for n in range(number) if there(n)), default=None)
        index = FlatIndex.new(spark, encoder.dim, id_type=kind) if before is None else FlatIndex.load(spark, f"{path}/{before}")
        tokens = encode.encode_documents(last_of_each(batch, order).select("doc_id", "text"), encoder)
        index.add(tokens.select("doc_id", "tok_pos", "embedding")).save(f"{path}/{number}")

    return run


def _parts(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the whole snapshots and of the deltas below path that were written to their end."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    names = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_about/_SUCCESS"))]
    whole = sorted(int(n) for n in names if n.isdigit())
    return whole, sorted(int(n.removesuffix(DELTA)) for n in names if n.endswith(DELTA))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def current(spark: SparkSession, path: str) -> Index:
    """The last whole snapshot and all deltas after it: of each document the rows of the last batch that had it."""
    whole, deltas = _parts(spark, path)
    if not whole:
        raise ValueError(f"no snapshot below {path}")
    base = api.load(spark, f"{path}/{whole[-1]}")
    parts = [(whole[-1], base), *((n, api.load(spark, f"{path}/{n}{DELTA}")) for n in deltas if n > whole[-1])]
    if len(parts) == 1:
        return base
    names = TABLES[type(base)]
    ids = reduce(DataFrame.unionByName, [getattr(i, names[0]).select("doc_id", F.lit(n).alias("_batch")) for n, i in parts])
    last = ids.groupBy("doc_id").agg(F.max("_batch").alias("_batch"))
    tables = {}
    for name in names:
        rows = reduce(DataFrame.unionByName, [getattr(i, name).withColumn("_batch", F.lit(n)) for n, i in parts])
        tables[name] = rows.join(last, ["doc_id", "_batch"], "left_semi").select(*getattr(base, name).columns)
    return replace(base, **tables)


def delta_upsert(path: str, encoder, start: Index | None = None, order: str = "ts", every: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for an index of any kind whose cost follows the batch: it writes the batch's own documents as a delta.

    The first batch is added to `start` (an empty flat index by default) and written whole. After `every` deltas they are merged into a
    new whole snapshot, and all that is older than the one before it goes, so that readers of that one can end. A repeated batch writes
    nothing; what an attempt left unfinished is written anew. A batch without rows gives an empty delta. `current` reads the state."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        whole, deltas = _parts(spark, path)
        if number in whole or number in deltas:
            return
        tokens = encode.encode_documents(last_of_each(batch, order).select("doc_id", "text"), encoder).select("doc_id", "tok_pos", "embedding")
        kind = batch.schema["doc_id"].dataType.simpleString()
        _remove(spark, f"{path}/{number}")
        if not whole:
            (start if start is not None else FlatIndex.new(spark, encoder.dim, id_type=kind)).add(tokens).save(f"{path}/{number}")
            return
        base = api.load(spark, f"{path}/{whole[-1]}")
        if isinstance(base, CompressedIndex):
            alone = replace(base, codes=None, postings=None)
        else:
            alone = replace(base, tokens=empty_tokens(spark, kind), **({"postings": None} if isinstance(base, CentroidIndex) else {}))
        _remove(spark, f"{path}/{number}{DELTA}")
        alone.add(tokens).save(f"{path}/{number}{DELTA}")
        if sum(n > whole[-1] for n in deltas) + 1 >= every:
            current(spark, path).save(f"{path}/{number}")
            for n in [*(n for n in whole if n < whole[-1]), *(f"{n}{DELTA}" for n in deltas if n <= whole[-1])]:
                _remove(spark, f"{path}/{n}")

    return run
