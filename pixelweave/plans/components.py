"""Connected components of an edge table by alternating stars.

Each round points every node's larger neighbours at its smallest neighbour
(large star), then its smaller neighbours at the smallest (small star). Edges
shrink to one star per component in a logarithmic number of rounds. All steps
are joins and partial aggregations, so a node with many edges is not gathered
into one task, and nothing is collected but two checksums a round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 100


def _star(edges: DataFrame, large: bool, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One star step on canonical edges (u > v)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.where("v > u").join(deal(low), "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(deal(low), "u")
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, workspace: Callable[[DataFrame, str], DataFrame], deal: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(node, component): component is the smallest node reachable.

    Nodes without an edge to another node are not listed. ``workspace`` writes
    a table to storage that outlives executors and reads it back; it cuts the
    lineage of every round. ``deal`` marks a side of each join, so that nodes
    that pack well are not broadcast by the size of their files. Null ends are
    ignored.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).alias("a"), F.col(dst).alias("b"))
    now = workspace(pairs.where("a IS NOT NULL AND b IS NOT NULL AND u != v").select("u", "v").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = workspace(_star(_star(now, True, deal), False, deal), "stars")
        print_ = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if print_ == seen or not print_[0]:
            break
        seen = print_
    else:
        raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
