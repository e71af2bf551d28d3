"""Ranking of symbols and chunks, with explicit tie order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.tokens import overlap, tokenize


def top_per_service(rows: DataFrame, score: str, order: str, per_service: int = 5, total: int = 40) -> DataFrame:
    """Best rows of each service, then the best overall; ties by the service's first row, then ``order``."""
    w = Window.partitionBy("service").orderBy(F.desc(score), order)
    first = rows.groupBy("service").agg(F.min(order).alias("service_first"))
    kept = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_service).join(first, "service")
    return kept.orderBy(F.desc(score), "service_first", order).limit(total).drop("service_first")


def rank_symbols(symbols: DataFrame, issue: Column, order: str, per_service: int = 5, total: int = 40) -> DataFrame:
    """Symbols by tokens shared with an issue's text; symbols that share none are left out."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("docstring", F.lit("")), F.coalesce("signature", F.lit("")))
    scored = symbols.withColumn("overlap", overlap(tokenize(text), tokenize(issue))).where("overlap > 0")
    return top_per_service(scored, "overlap", order, per_service, total)


def best_chunk(hits: DataFrame, order: str) -> DataFrame:
    """The best-scored chunk of each function, the first of equals."""
    w = Window.partitionBy("service", "function_qualified_name").orderBy(F.desc("score"), order)
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def suppress_members(functions: DataFrame, selected_classes: DataFrame) -> DataFrame:
    """Functions but for methods of a class that was selected itself."""
    c = selected_classes.select("service", F.col("qualified_name").alias("parent_class")).distinct()
    return functions.join(c, ["service", "parent_class"], "left_anti")
