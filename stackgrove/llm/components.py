"""Connected components of a graph given as edges, in the cluster: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rounds after which something must be wrong: stars need about log2 of the longest path, squared.
ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (src, dst, both long).

    Loops, repeated edges and either direction are fine; edges with a null end are left out; no
    edges, no rows. Each round is cut by written tables, so a lost executor costs its own tasks and
    plans don't grow. Both sides of each join are read from tables: a hub's rows can be split.
    """
    now = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    now, mark, held = scratch.table(now, "edges-0"), None, "edges-0"
    for k in range(1, ROUNDS + 1):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"least-{k}")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.table(large, f"large-{k}")
        low = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), f"low-{k}")
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.table(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"edges-{k}")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for name in (held, f"least-{k}", f"large-{k}", f"low-{k}"):
            scratch.drop(name)
        now, held = new, f"edges-{k}"
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = tuple(seen)
    raise RuntimeError("components did not settle")
