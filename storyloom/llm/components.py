"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every greater neighbour of a node moves to the least of the node and its neighbours; and the saved minima.

    The minima are saved so that both sides of the join come straight from a shuffle: only then may Spark split
    the partition of a hub."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every smaller neighbour of a node, and the node, move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = saved(down.groupBy("a").agg(F.min("b").alias("m")))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b"), least


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """edges: a, b (long). Returns doc_id and component_id, the least id reachable, for every id on an edge between
    two different ids; null ids are on no edge, repeated edges count once, no edges give no rows.

    Each round is written to the shared folder. The number of rounds grows with the logarithm of the longest
    chain; should the edges still change after `rounds`, that is an error, never a wrong answer."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        large, first = _large_star(now)
        middle = saved(large.distinct())
        discard(now, first)
        small, second = _small_star(middle)
        now = saved(small.distinct())
        discard(middle, second)
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, total) == mark:
            break
        mark = (count, total)
    else:
        raise RuntimeError(f"the components of {mark[0] if mark else 0} edges still change after {rounds} rounds")
    members = now.groupBy("a").agg(F.min("b").alias("component_id")).select(F.col("a").alias("doc_id"), "component_id")
    return members.unionByName(members.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
