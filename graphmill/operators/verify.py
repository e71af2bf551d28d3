"""Proposed file changes checked against the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.paths import dirname, normal_path, normal_symbol
from graphmill.operators.graph import folder_exists, symbol_files


def verify_changes(changes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``changes(change_id, service, file_path, symbol, change_type)`` -> status and corrected path.

    Status is ``verified``, ``corrected``, ``new`` or ``unverified``; the facts are joined once for all
    changes and one expression decides.
    """
    c = changes.select("change_id", "service", normal_path(F.col("file_path")).alias("path"), F.nullif(normal_symbol(F.col("symbol")), F.lit("")).alias("symbol"), "change_type")
    c = c.withColumns({"folder": F.regexp_replace("path", "/+$", ""), "parent": dirname(F.col("path"))})
    known = files.select("service", F.col("file_path").alias("path")).distinct().withColumn("is_file", F.lit(True))
    folders = folder_exists(files, c.select("service", "folder").unionByName(c.select("service", F.col("parent").alias("folder"))).where("folder is not null and folder <> ''"))
    dirs = folders.withColumn("yes", F.lit(True))
    named = symbol_files(symbols, c.where("symbol is not null"))
    # Parts of a dotted symbol that the file itself defines.
    parts = c.where("symbol is not null and path is not null").select("change_id", "service", "path", F.explode(F.array_distinct(F.split("symbol", r"\."))).alias("part"))
    tail = F.element_at(F.split("qualified_name", "::"), -1)
    own = symbols.select("service", F.col("file_path").alias("path"), F.explode(F.array_distinct(F.array("name", tail))).alias("part")).distinct()
    inside = parts.join(own, ["service", "path", "part"]).groupBy("change_id").agg(F.count("*").alias("n_parts"), F.min("part").alias("a_part"))
    j = c.join(known, ["service", "path"], "left").join(dirs.withColumnRenamed("yes", "is_folder"), ["service", "folder"], "left")
    j = j.join(dirs.select("service", F.col("folder").alias("parent"), F.col("yes").alias("has_parent")), ["service", "parent"], "left")
    j = j.join(named, ["service", "symbol"], "left").join(inside, "change_id", "left")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    paths = F.coalesce("file_paths", F.array().cast("array<string>"))
    under = F.filter(paths, lambda p: p.startswith(F.concat(F.col("folder"), F.lit("/"))))
    j = j.withColumn("found", F.when((F.size(paths) > 1) & F.col("path").isNotNull() & (F.size(under) == 1), under).otherwise(paths))
    create = F.when(F.col("path").isNull(), "unverified").when(yes("is_file"), "new").when(yes("is_folder"), "unverified").when(yes("has_parent"), "new").otherwise("unverified")
    exact = F.coalesce(F.array_contains(paths, F.col("path")), F.lit(False))
    change = (
        F.when(exact, "verified")
        .when(F.size("found") == 1, "corrected")
        .when(F.size("found") > 1, "unverified")
        .when(yes("is_file") & F.col("symbol").isNull(), "verified")
        .when(yes("is_file") & (F.col("n_parts") == 1), "corrected")
        .otherwise("unverified")
    )
    made = F.col("change_type") == "create"
    status = F.when(made, create).otherwise(change)
    return j.select(
        "change_id",
        "service",
        status.alias("status"),
        F.when(~made & ~exact & (F.size("found") == 1), F.get("found", F.lit(0))).otherwise(F.col("path")).alias("file_path"),
        F.when(~made & ~exact & (F.size("found") == 0) & yes("is_file") & (F.col("n_parts") == 1), F.col("a_part")).otherwise(F.col("symbol")).alias("symbol"),
    )


def shown(names, first: int = 3):
    """First few of a list and how many more there are."""
    more = F.size(names) - first
    return F.concat(F.array_join(F.slice(names, 1, first), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
