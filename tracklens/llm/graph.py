"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: A key of more edges than this (and than a ten-thousandth of all, so that there are at most HOT such keys) is hot.
MANY, HOT = 1000, 10_000


def with_low(edges: DataFrame, low: DataFrame, key: str, n: int) -> DataFrame:
    """``edges`` (a, b) with ``low`` (node, low) of their column ``key``, or null; edges of hot keys are not dealt by it but meet a broadcast of at most HOT rows."""
    hot = edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(MANY, n // HOT)).select(F.col(key).alias("node"))
    found = hot.join(low, "node", "left").select(F.col("node").alias(key), F.col("low").alias("hot_low"), F.lit(True).alias("is_hot"))
    if not (rows := found.collect()):  # at most HOT
        return edges.join(low.withColumnRenamed("node", key), key, "left").select("a", "b", "low")
    known = edges.join(F.broadcast(edges.sparkSession.createDataFrame(rows, found.schema)), key, "left")
    usual = known.where("is_hot IS NULL").select("a", "b").join(low.withColumnRenamed("node", key), key, "left").select("a", "b", "low")
    return usual.unionByName(known.where("is_hot").select("a", "b", F.col("hot_low").alias("low")))


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``edges`` (a, b), any order, no nulls; returns each node of an edge with the least node of its component (node, root).

    All work is in joins and partial aggregates of edges, whose number never grows, and every
    step is written, so no lineage builds up and no component is gathered anywhere, nor are the
    edges of one node.  Rounds grow with the logarithm of a component's size; beyond ``rounds``
    it is an error.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = mark(edges)
    for _ in range(rounds):
        if not last[0]:
            break
        # edges point down from a to b.  Large star: the higher neighbours of b go to the least of b and its neighbours
        low = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        large = with_low(edges, low, "b", last[0]).select("a", F.coalesce("low", "b").alias("b")).distinct()
        large = staged(large, "edges")
        # small star: the lower neighbours of a, and a, go to the least of them
        low = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        near = with_low(large, low, "a", last[0]).select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = near.unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()
        before, edges = edges, staged(small, "edges")
        discard(before, large)
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
