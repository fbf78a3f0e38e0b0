"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.session import drop_path, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component = smallest node reachable.

    Alternating large-star and small-star steps: each round is two shuffles of
    the remaining edges, and the number of rounds grows with the logarithm of
    the longest chain. Nothing is collected but one count and one hash sum.
    """
    spark = edges.sparkSession
    cur, path = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    mark = None
    for _ in range(max_rounds):
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == now or not now[0]:
            break
        mark = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt, nxt_path = materialize(small, "cc")
        drop_path(spark, path)
        cur, path = nxt, nxt_path
    else:
        raise RuntimeError("components did not settle")
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
