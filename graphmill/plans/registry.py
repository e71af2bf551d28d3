"""All core queries and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphmill.plans import problems, reference, service

MODULES = [problems, reference, service]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["ref_t4_merge_candidates"](spark, sf_dir)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
