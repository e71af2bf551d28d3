"""Problems 4, 5 and 6: documented functions, files that do not parse, files not written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.filesymbols import parse_grammar_symbols
from graphmill.llm.handwritten import not_handwritten
from graphmill.llm.sourcefiles import CHECKED, documented_functions, invalid_files
from graphmill.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "source_files")).select("file_id", "qualified_name").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "source_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a first unrecoverable error, which is looked for as in ``p5_errors``."""
    return invalid_files(table(spark, sf_dir, "source_files")).select("file_id")


def p5_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unrecoverable error of each file."""
    return invalid_files(table(spark, sf_dir, "source_files"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of invalid files by service and language, beside the ingestion's own failure counter."""
    files = table(spark, sf_dir, "source_files")
    bad = invalid_files(files, where=False).groupBy("service", "language").agg(F.count("*").alias("invalid"))
    base = files.where(F.col("language").isin(CHECKED) & F.col("content").isNotNull()).groupBy("service", "language").agg(F.count("*").alias("files"))
    failed = table(spark, sf_dir, "repo_graphs").groupBy("service").agg(F.sum("files_failed").alias("files_failed"))
    out = base.join(bad, ["service", "language"], "left").join(failed, "service", "left")
    n = F.coalesce("invalid", F.lit(0))
    return out.select("service", "language", "files", n.alias("invalid"), F.round(n / F.col("files"), 6).alias("rate"), "files_failed")


#: The company whose own copyright lines say nothing (TESTDATA.md).
OWN = ("lattice foundry",)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "source_files"), OWN).select("file_id").distinct()


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files not written by hand, by service, language and reason."""
    return not_handwritten(table(spark, sf_dir, "source_files"), OWN).groupBy("service", "language", "reason").agg(F.count("*").alias("files"))


def p15_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and functions of the languages that ``ref_p15_symbols`` leaves to a grammar."""
    return parse_grammar_symbols(table(spark, sf_dir, "source_files"))


def queries() -> dict:
    return {"ref_p15_grammar_symbols": p15_grammar, "p4_found": p4_found, "p4_pairs": p4_pairs, "p5_found": p5_found, "p5_errors": p5_errors, "p5_rates": p5_rates, "p6_found": p6_found, "p6_reasons": p6_reasons}
