"""Connected components by alternating large-star and small-star rounds on a table of links.

Nothing about the links or components goes to the driver but whether they are stars yet; every round
is written to the shared folder, so lost executors cost one round at most and lineage stays short. Minima are
pre-aggregated. A node with more than 1/HUBS of all links is a hub: there are fewer than HUBS of them at any size, so their
minima are broadcast, and no key of the shuffled join has more rows than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenweft.llm._common import stored


def are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is itself a u: then the v are the roots."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    seen = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return seen.where("child > 1 or (child > 0 and root > 0)").isEmpty()


HUBS = 500


def join_hubs(rows: DataFrame, known: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of known(key, n, ...), whose n is the key's number of rows, `total` in all; keys that known lacks go.

    Known rows of hubs are broadcast: fewer than HUBS, since each has more than a share of 1/HUBS of the rows.
    """
    many = F.col("n") > max(1000, total // HUBS)
    names = [c for c in known.columns if c not in (key, "n")]
    hubs = known.where(many).select(F.col(key).alias("_hub"), *(F.col(c).alias(f"_{c}") for c in names))
    marked = rows.join(F.broadcast(hubs), rows[key] == F.col("_hub"), "left")
    others = marked.where("_hub is null").select(*rows.columns).join(known.where(~many).drop("n"), key).select(*rows.columns, *names)
    return others.unionByName(marked.where("_hub is not null").select(*rows.columns, *(F.col(f"_{c}").alias(c) for c in names)))


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): m is the least v of each u."""
    return join_hubs(edges, stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))), "u", total)


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long): root is the least node of its component. Nulls and loops are dropped."""
    edges = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges)
    for _ in range(rounds):
        if are_stars(edges):
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * edges.count()
        large = with_least(both, total).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = with_least(stored(large), total)
        small = low.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
