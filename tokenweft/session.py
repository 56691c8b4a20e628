"""Session settings and the check that stands before every broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Bytes up to which a side counts as small enough to broadcast.
BROADCAST_BYTES = 64 << 20


def session(cores: int | str = "*", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tokenweft")
    base = {
        "spark.sql.shuffle.partitions": str(os.cpu_count() if cores == "*" else cores), "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            inner = F.aggregate(c, F.lit(0).cast("long"), lambda t, x: t + 16 + 8 * F.size(x)) if isinstance(f.dataType.elementType, ArrayType) else 8 * F.size(c)
            parts.append(F.coalesce(inner, F.lit(0)))
        elif isinstance(f.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
    return sum(parts, F.lit(32 + 8 * len(df.columns)).cast("long"))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, written once, with a broadcast hint if its rows take at most `most` bytes; else the planner shuffles both sides."""
    df = cut(df)
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= most else df


def work_dir(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tokenweft-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a short lineage that survives lost executors."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
