"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace


def _least(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions -> (u, v, m): m is the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _least(down)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Edges (a, b) -> (node, component), component the least node reachable; only nodes with edges.

    Each round is a table in the shared folder; every round is a few keyed shuffles
    whose aggregations combine before the shuffle. Nothing is collected but two sums.
    """
    now = ws.save(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}_0")
    seen, round_no = None, 0
    while True:
        round_no += 1
        after = ws.save(_small_star(_large_star(now)), f"{name}_{round_no}")
        mark = after.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(f"{name}_{round_no - 1}")
        if tuple(mark) == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, now = tuple(mark), after
