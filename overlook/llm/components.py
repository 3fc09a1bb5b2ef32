"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation and one join on the node; every round is written to the shared folder, so
that lineage stays short and a lost executor costs one task. Hubs are safe: the minimum is aggregated
before the shuffle, and the join back has one row per node on one side, which the engine can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, kept_apart, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a long, b long); component is the smallest node that its links reach."""
    spark = edges.sparkSession
    before: list[str] = []
    with kept_apart() as written:
        now = materialize(_oriented(edges), "links")
        mark = _mark(now)
        while True:
            before, now = [*written], materialize(_small_star(_large_star(now)), "links")
            discard(spark, before)  # the round before has been read for the last time
            written[:] = [p for p in written if p not in before]
            new = _mark(now)
            if new == mark:
                break
            mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node a to the smaller node b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64("b", "a"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node joins the smallest node around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # (larger neighbour v, node u): edges as they are, with a = v and b = u
    return _oriented(edges.join(least.withColumnRenamed("a", "b"), "b").select(F.col("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours join the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(least.select("a", F.col("m").alias("b"))))
