"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a pair of aggregates and joins whose result is written to the shared folder; no
links or labels are gathered on the driver. A node's neighbours are never collected: the smallest
one is an aggregate, and it meets the links again in a join that can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v. Links every larger neighbour (large) or every smaller one and the node itself (small) to the smallest of the neighbourhood."""
    around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = around.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node with a link; the label is the smallest node of the component. edges: (u, v) longs."""
    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v")).distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == before or not state["n"]:
            break
        before, k = (state["n"], state["s"]), k + 1
        last = now
        now = scratch.keep(_star(_star(now, True), False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 2}") if k > 1 else None
        del last
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
