"""Problem 2: most similar vectors for every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.neighbors import mutual_pairs, similar_vectors
from graphmill.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "chunks"), "chunk_id", "embedding", k=5, min_sim=0.85, relax=1.0)
    return mutual_pairs(near).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p2_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "chunks"), "chunk_id", "embedding", k=5)
    return near.select(F.col("id").alias("chunk_id"), F.col("neighbor").alias("neighbor_id"), "cosine", "rank")


def queries() -> dict:
    return {"p2_found": p2_found, "p2_neighbors": p2_neighbors}


SQL = {
    "p2_found": (
        "WITH u AS (SELECT DISTINCT chunk_id AS id, embedding AS e, list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') AS m FROM chunks WHERE len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0), "
        # Scaled by the largest number, so that no square underflows.
        "v AS MATERIALIZED (SELECT id, list_transform(e, lambda x: x / m) AS e FROM u WHERE m > 0), "
        "s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.id <> b.id), "
        "r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM s WHERE c >= 0.85) "
        "SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE n <= 5"
    ),
}


def oracle_sql() -> dict[str, str]:
    return SQL
