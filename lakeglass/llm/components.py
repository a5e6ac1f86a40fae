"""Connected components of an undirected graph of ids, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has an edge to another.

    Alternating large-star and small-star rounds: each hooks a node's neighbours to the smallest id around it, so the graph
    becomes a forest of stars after a number of rounds that grows with the logarithm of the largest component. Minima are
    pre-aggregated before the shuffle, and the joins that give them back can be split where a node has very many edges.
    Every round is written to the shared folder. Edges with a null end and loops are ignored.
    """
    star = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    star = durable(star)
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: the neighbours above u, and u itself, go to the smallest of u and its neighbours
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: Spark splits a join's large partitions only if both sides come straight from an exchange
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = durable(large.distinct())
        # small star: the neighbours below u, and u itself, go to the smallest of them
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        hooked = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = durable(hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    members = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
