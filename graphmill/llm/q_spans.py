"""Problem 10: long exact spans shared between records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphmill.llm.spans import aligned_passages, documents_with_shared_spans, shared_report
from graphmill.session import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_with_shared_spans(table(spark, sf_dir, "documents"), min_len=200)


def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_report(table(spark, sf_dir, "documents"), min_len=200)


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's passages with a partner and what it takes to turn one into the other."""
    return aligned_passages(table(spark, sf_dir, "documents"), min_len=200)


def queries() -> dict:
    return {"p10_found": p10_found, "p10_report": p10_report, "p10_passages": p10_passages}


SQL = {
    "p10_found": (
        "WITH t AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200), "
        "w AS MATERIALIZED (SELECT DISTINCT doc_id, md5(substring(text, i, 200)) AS s FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM t)), "
        "twice AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1) "
        "SELECT DISTINCT doc_id FROM w WHERE s IN (SELECT s FROM twice)"
    ),
}


def oracle_sql() -> dict[str, str]:
    return SQL
