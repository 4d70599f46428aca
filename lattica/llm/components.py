"""Connected components of an edge table by alternating large and small stars, on Spark tables only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import base


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (large star) or not larger neighbours move to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    moved = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """edges: a, b (long). Returns node, label (the smallest node that it reaches) for the nodes of edges. Each round is
    a table in the shared folder, so no lineage grows and no link reaches the driver."""
    now, last = base.written(edges.where("a <> b").select("a", "b").distinct(), f"{folder}/edges"), None
    for i in count():
        now = base.written(_star(_star(now, True), False), f"{folder}/stars{i}")
        # Two equal sums of a round's edges: the stars stand still.
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        last = mark
