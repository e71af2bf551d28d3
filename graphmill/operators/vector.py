"""Exact vector top-k by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long vectors, null where one is null, empty, zero or of another length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def top_k(rows: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None, prefilter: bool = False) -> DataFrame:
    """The ``k`` rows nearest to one query vector with ``score`` (6 decimals), ties by key.

    ``where`` is applied to the ``k`` hits, so it may leave fewer; ``prefilter`` applies it before.
    Unusable vectors are never hits. The plan is a scan and a bounded top-k per task.
    """
    if where is not None and prefilter:
        rows = rows.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", F.round(cosine(F.col(vector).cast("array<double>"), q), 6)).where(F.col("score").isNotNull() & ~F.isnan("score"))
    hits = scored.orderBy(F.desc("score"), key).limit(k)
    return hits.where(where) if where is not None and not prefilter else hits
