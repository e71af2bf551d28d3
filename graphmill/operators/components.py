"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two equi-joins, so a hub with a third of
all edges costs partial aggregates, never one task's memory. The number of rounds grows with the
logarithm of the component diameter. Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import checkpoint


def _with_least(nbr: DataFrame) -> DataFrame:
    low = nbr.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return nbr.join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of one orderable type -> ``(node, label)``; the label is the smallest node.

    Nulls and self-links are ignored; nodes without a link to another node don't come out (their
    label is themselves). An empty input gives an empty output.
    """
    # Every stage that is read more than once is cut off, or plans would double with each use.
    edges = checkpoint(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        edges = checkpoint(_small_star(checkpoint(_large_star(edges))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        seen = now
    raise RuntimeError("components did not settle")
