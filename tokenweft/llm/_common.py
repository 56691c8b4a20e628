"""Helpers shared by the operators: code shipping, shared tables, ordered prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package and keep numpy single-threaded beside Spark's own tasks."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        env.setdefault(name, "1")
    env.setdefault("TOKENIZERS_PARALLELISM", "false")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder; a temporary one only where none is set on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tokenweft-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tokenweft-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def stored(df: DataFrame, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict = {}


def held(name, make: Callable):
    """A worker process's cache by that name. Caches of another name go first: a worker serves stage after stage, but one at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Give memory that Arrow and the C library hold but do not use back to the system; where the library has no such call, Arrow's alone."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _uncollected(f):
    """f with the cycle collector off: it makes millions of small objects and no cycles, and is read by reference counts alone.

    Workers outlive their tasks, so each gives back at the end what it no longer uses: the next stage has its own needs.
    """

    def run(batches):
        gc.disable()
        try:
            yield from f(batches)
        finally:
            gc.enable()
            release()

    return run


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    attach(df.sparkSession)
    return df.mapInArrow(_uncollected(f), schema)


def filtered(docs: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, where keep says so of a block of texts; no shuffle."""

    def run(batches):
        for whole in batches:
            for batch in text_runs(whole):
                yield batch.filter(pa.array(keep(batch)))

    return mapped(docs, run, docs.schema)


def runs(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose summed lengths stay near limit (one row at least), so that Python objects stay bounded."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_runs(batch: pa.RecordBatch, column: str = "text", limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about limit bytes of text each; nulls count nothing."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)).astype(int)
    for a, b in runs(sizes.tolist(), limit):
        yield batch.slice(a, b - a)


#: Keys that may travel to every task: 32 MB of longs.
SHIPPED = 4_000_000


def shipped(keys: DataFrame, most: int | None = None) -> Broadcast | None:
    """The distinct values of a frame's one column of longs, sorted, for every task; None where there are more than `most`.

    All keys or none, so whoever gets None joins instead and has the same rows.
    """
    keys = stored(keys.dropna().distinct())
    if keys.count() > (SHIPPED if most is None else most):
        return None
    return keys.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy()))


def among(known: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each long of a column is one of the sorted keys; nulls are not."""
    if not len(known):
        return np.zeros(len(column), bool)
    values = column.fill_null(0).to_numpy(zero_copy_only=False)
    found = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
    return found & column.is_valid().to_numpy(zero_copy_only=False)


def is_shipped(key: Column, known: Broadcast) -> Column:
    """Whether a column of longs is one of the shipped keys; only that column goes to Python."""
    return F.arrow_udf(lambda column: pa.array(among(known.value, column)), "boolean")(key)


def quantiles(df: DataFrame, key: str, rows_per_bucket: int, most: int) -> tuple[list, list]:
    """(bounds that deal the values of an integer column into ordered buckets of similar size, values that fill a bucket alone).

    Both have at most `most` entries, so what the driver holds does not grow with the rows.
    """
    n = df.count()
    k = min(most, max(1, n // rows_per_bucket))
    if k == 1:
        return [], []
    probabilities = [i / k for i in range(1, k)]
    found = df.agg(F.percentile_approx(key, probabilities, max(10_000, 10 * k)).alias("b")).first()["b"] or []
    return sorted(set(found)), sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})


def bucket_of(key: Column, bounds: list) -> Column:
    """0 for values (and nulls) up to the first bound, one more after each further bound; two steps over a folded literal."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.from_json(F.lit(json.dumps(bounds[step - 1 :: step])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    at = F.coalesce(F.size(F.filter(coarse, lambda b: b < key)), F.lit(0)) * step
    return at + F.coalesce(F.size(F.filter(F.slice(fine, at + 1, F.lit(step)), lambda b: b < key)), F.lit(0))


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those with the least hashes of an integer key.

    Of a table with many more rows only hashes below twice the wanted share are sorted, so the last task of the sort
    sees a few times `most` rows at any size; the rows are the same as without that filter.
    """
    h, n = F.xxhash64(key), rows.count()
    if n > 4 * most:
        rows = rows.where(h <= F.lit(-(1 << 63) + int((1 << 64) * (2 * most + 1000) / n)).cast("long"))
    return rows.orderBy(h, key).limit(most)


def bounded(found: DataFrame, size: Column, most_rows: int, most_size: int) -> pa.Table:
    """The rows of `found`, which is written first, for the driver: the first ids by a hash, as long as they come to at most `most_rows` rows and
    the sum of `size` stays within `most_size`. An id that many rows share is taken with all of them or ends the list."""
    found = stored(found.withColumn("_h", F.xxhash64("doc_id")))
    keys = found.select("_h", "doc_id", size.cast("long").alias("n")).orderBy("_h", "doc_id").limit(most_rows + 1).toArrow()
    h, ids, total = keys.column("_h").to_numpy(), keys.column("doc_id").to_numpy(), np.cumsum(keys.column("n").to_numpy())
    fits = (total <= most_size) & (np.arange(len(h)) < most_rows)
    n = len(h) if fits.all() else int(np.argmin(fits))
    if n < len(h):
        while n and ids[n - 1] == ids[n]:
            n -= 1
        last = (F.col("_h") < F.lit(int(h[n]))) | (F.col("_h") == F.lit(int(h[n]))) & (F.col("doc_id") < F.lit(int(ids[n])))
        found = found.where(last)
    return found.drop("_h").toArrow()


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n
