"""Per-service digests of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.paths import is_entry_point


def dominant_language(symbols: DataFrame, order: str) -> DataFrame:
    """Most frequent language; of equals the one met first, classes before functions."""
    seen = F.struct((F.col("kind") != "class").alias("k"), F.col(order).alias("o"))
    g = symbols.groupBy("service", "language").agg(F.count("*").alias("n"), F.min(seen).alias("first"))
    w = Window.partitionBy("service").orderBy(F.desc("n"), "first")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select("service", "language", "n")


def entry_points(symbols: DataFrame, languages: DataFrame) -> DataFrame:
    s = symbols.select("service", "file_path").distinct().join(languages.select("service", "language"), "service")
    hit = s.where(is_entry_point(F.col("file_path"), F.col("language")))
    return hit.groupBy("service").agg(F.sort_array(F.collect_set("file_path")).alias("entry_points"))


def top_classes(symbols: DataFrame, order: str, limit: int = 15) -> DataFrame:
    """Classes by number of methods, in input order among equals."""
    methods = symbols.where("kind = 'function' and is_method and parent_class is not null").groupBy("service", F.col("parent_class").alias("qualified_name")).agg(F.count("*").alias("methods"))
    c = symbols.where("kind = 'class'").join(methods, ["service", "qualified_name"], "left").withColumn("methods", F.coalesce("methods", F.lit(0)))
    w = Window.partitionBy("service").orderBy(F.desc("methods"), order)
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("service", "qualified_name", "name", "docstring", "methods", "rank")


def top_functions(symbols: DataFrame, order: str, limit: int = 20) -> DataFrame:
    w = Window.partitionBy("service").orderBy(order)
    f = symbols.where("kind = 'function' and not coalesce(is_method, false)")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("service", "name", "rank")


def digest(symbols: DataFrame, order: str) -> DataFrame:
    """One record per service: language, entry points, classes and top-level functions."""
    lang = dominant_language(symbols, order)
    classes = top_classes(symbols, order).groupBy("service").agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("c"))
    functions = top_functions(symbols, order).groupBy("service").agg(F.sort_array(F.collect_list(F.struct("rank", "name"))).alias("f"))
    empty = F.array().cast("array<string>")
    out = lang.join(entry_points(symbols, lang), "service", "left").join(classes, "service", "left").join(functions, "service", "left")
    return out.select("service", "language", F.coalesce("entry_points", empty).alias("entry_points"), F.coalesce("c.name", empty).alias("classes"), F.coalesce("f.name", empty).alias("top_level_functions"))
