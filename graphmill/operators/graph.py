"""Service graph: expansion, induced edges and symbol lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_neighbors(calls: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``(name, hop_distance)`` of services within ``hops`` undirected calls of any seed, seeds left out.

    One join per hop; each step keeps only names not reached before, so rows stay bounded by the nodes.
    """
    both = calls.select("source", "target").unionByName(calls.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    reached = seeds.select("name").distinct().withColumn("hop_distance", F.lit(0))
    front = reached
    for h in range(1, hops + 1):
        nxt = front.join(both, front["name"] == both["source"]).select(F.col("target").alias("name")).distinct()
        front = nxt.join(reached.select("name"), "name", "left_anti").withColumn("hop_distance", F.lit(h))
        reached = reached.unionByName(front)
    return reached.where("hop_distance > 0")


def edges_among(calls: DataFrame, names: DataFrame) -> DataFrame:
    n = names.select("name").distinct()
    return calls.join(n.withColumnRenamed("name", "source"), "source", "left_semi").join(n.withColumnRenamed("name", "target"), "target", "left_semi").select("source", "target").distinct()


def merge_candidates(hits: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Vector hits by score, then neighbours by distance, each name once: ``(name, position)``."""
    from pyspark.sql import Window

    a = hits.select("name", F.lit(0).alias("src"), (-F.col("score")).alias("k"))
    b = neighbors.select("name", F.lit(1).alias("src"), F.col("hop_distance").cast("double").alias("k"))
    best = a.unionByName(b).groupBy("name").agg(F.min(F.struct("src", "k")).alias("m"))
    # At most the top hits and their neighbourhood, a few dozen services.
    return best.select("name", F.row_number().over(Window.orderBy("m.src", "m.k", "name")).alias("position"))


def symbol_files(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(service, symbol, file_paths)``: files whose symbols answer to a name, sorted.

    A symbol answers to its name and to its qualified name's part after ``::`` and after the last dot.
    """
    tail = F.element_at(F.split("qualified_name", "::"), -1)
    names = F.array_distinct(F.array("name", tail, F.element_at(F.split(tail, r"\."), -1)))
    keyed = symbols.select("service", "file_path", F.explode(names).alias("symbol")).distinct()
    return keyed.join(wanted.select("service", "symbol").distinct(), ["service", "symbol"]).groupBy("service", "symbol").agg(F.sort_array(F.collect_set("file_path")).alias("file_paths"))


def folder_exists(files: DataFrame, folders: DataFrame) -> DataFrame:
    """``(service, folder)`` of folders under which a file lies; by equi-join on every ancestor folder."""
    parts = F.split("file_path", "/")
    up = files.select("service", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, i), "/")))).alias("folder")).distinct()
    want = folders.select("service", F.regexp_replace("folder", "/+$", "").alias("folder")).distinct()
    return want.join(up, ["service", "folder"], "left_semi")
