"""K-means: nearest-centroid assignment, Lloyd iterations as plans, and the library's trainer for large sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tokenweft.functions.vectors import unit_centroid
from tokenweft.operators.kernel import matrix
from tokenweft.session import BROADCAST_BYTES, attach, cut, row_bytes, small

DIGITS = 9
#: Rows on which centroids may be trained; a documented bound. All rows are assigned.
TRAIN_ROWS = 200_000


def seeds(vectors: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(centroid_id, vector): k rows in the order of a hash of their key, numbered from 0; fewer if there are fewer."""
    first = vectors.select(key, "embedding").withColumn("_h", F.md5(F.col(key).cast("string").cast("binary"))).orderBy("_h", key).limit(k)
    return first.select((F.row_number().over(Window.orderBy("_h", key)) - 1).cast("int").alias("centroid_id"), F.col("embedding").alias("vector"))


def assign(vectors: DataFrame, centroids: DataFrame, metric: str = "cosine") -> DataFrame:
    """vectors plus centroid_id: the largest product (cosine) or the least distance (l2); the lowest id of equal ones.

    The codebook, at most BROADCAST_BYTES, is shipped to the tasks, and each Arrow batch is one matrix product: no row is multiplied or shuffled.
    """
    book = cut(centroids.select(F.col("centroid_id").cast("int").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("v")))
    if (book.agg(F.sum(row_bytes(book))).first()[0] or 0) > BROADCAST_BYTES:
        raise ValueError(f"a codebook may take {BROADCAST_BYTES} bytes at most")
    table = book.toArrow().sort_by("id").combine_chunks()
    ids = table.column("id").to_numpy()
    points = matrix(pa.concat_arrays(table.column("v").chunks)) if len(ids) else np.empty((0, 0))
    attach(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, points, (points * points).sum(1)))

    def run(batches):
        names, book, norms = shared.value
        for batch in batches:
            lists = batch.column("embedding")
            some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)) if len(names) else np.empty(0, int)
            best = np.zeros(batch.num_rows, np.int32)
            if len(some):
                rows = matrix(lists.filter(lists.is_valid()) if lists.null_count else lists)
                for s in range(0, len(rows), 1024):
                    near = rows[s : s + 1024] @ book.T
                    far = -near if metric == "cosine" else norms - 2 * near + (rows[s : s + 1024] ** 2).sum(1)[:, None]
                    best[some[s : s + 1024]] = names[np.round(far, DIGITS).argmin(1)]
            known = np.ones(batch.num_rows, bool)
            known[some] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32(), mask=known)], names=[*batch.schema.names, "centroid_id"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("centroid_id", IntegerType())]))


def normalized(centroids: DataFrame) -> DataFrame:
    return centroids.withColumn("vector", unit_centroid("vector"))


def lloyd(vectors: DataFrame, centroids: DataFrame, iterations: int = 10, normalize: bool = False) -> DataFrame:
    """Centroids after some L2 iterations from given ones; a centroid without vectors stays where it is. Deterministic."""
    now = cut(centroids.select("centroid_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")))
    for _ in range(iterations):
        parts = assign(vectors.select("embedding"), now, "l2").select("centroid_id", F.posexplode("embedding").alias("i", "x"))
        means = parts.groupBy("centroid_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        moved = means.groupBy("centroid_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("moved"))
        now = cut(now.join(small(moved), "centroid_id", "left").select("centroid_id", F.coalesce("moved", "vector").alias("vector")))
    return normalized(now) if normalize else now


def train(vectors: DataFrame, k: int, iterations: int = 10, seed: int = 42, normalize: bool = True, rows: int = TRAIN_ROWS) -> DataFrame:
    """(centroid_id, vector) by the library's K-means on at most `rows` vectors; at most as many centroids as different vectors.

    Equal vectors train as one of their number's weight: the library's start drops equal samples and then misses centroids."""
    n, by = vectors.count(), F.xxhash64(*vectors.columns)
    some = vectors.withColumn("_h", by)
    if n > 4 * rows:  # only hashes below twice the wanted share are sorted, so the last task sees a few times `rows` vectors at any size
        some = some.where(F.col("_h") <= F.lit(-(1 << 63) + int((1 << 64) * (2 * rows + 1000) / n)).cast("long"))
    sample = some.orderBy("_h").limit(rows).groupBy(F.col("embedding").cast("array<double>").alias("embedding")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    data = cut(sample.orderBy(F.xxhash64("embedding"))).select(array_to_vector("embedding").alias("features"), "weight")
    k = min(k, data.count())
    if k < 1:
        return vectors.sparkSession.createDataFrame([], "centroid_id int, vector array<double>")
    if k == 1:
        one = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        found = one.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector")).select(F.lit(0).alias("centroid_id"), "vector")
    else:
        centers = KMeans(k=k, initMode="random", maxIter=iterations, seed=seed, weightCol="weight").fit(data).clusterCenters()
        found = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "centroid_id int, vector array<double>")
    return normalized(found) if normalize else found
