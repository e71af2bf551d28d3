"""Problem 8: filling fixed-capacity containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.llm.packing import pack_items
from graphmill.llm.tokens import with_token_counts
from graphmill.session import materialize, table


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    items = materialize(with_token_counts(docs, {"doc_id": F.col("doc_id")}), "p8-items")
    return pack_items(items, table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs, their tokens and the share of room used, by pack size."""
    p = p8_packs(spark, sf_dir).where("pack_id is not null")
    out = p.groupBy("pack_name", "capacity_tokens").agg(F.countDistinct("pack_id").alias("packs"), F.sum("piece_tokens").alias("tokens"), F.sum((F.col("piece_start") > 0).cast("int")).alias("cut_pieces"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 6))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of each pack size: the placed and the empty documents, overfull packs, overlapping
    pieces, documents whose pieces don't add up, and cut documents that would have fitted."""
    docs = table(spark, sf_dir, "documents")
    items = materialize(with_token_counts(docs, {"doc_id": F.col("doc_id")}), "p8-items")
    pieces = materialize(pack_items(items, table(spark, sf_dir, "pack_sizes")), "p8-pieces")
    size = ["pack_name", "capacity_tokens"]
    inside = pieces.where("pack_id is not null")
    before = Window.partitionBy(*size, "pack_id").orderBy("pack_offset").rowsBetween(Window.unboundedPreceding, -1)
    clash = inside.withColumn("end", F.max(F.col("pack_offset") + F.col("piece_tokens")).over(before)).where(F.col("end") > F.col("pack_offset"))
    full = inside.groupBy(*size, "pack_id").agg(F.sum("piece_tokens").alias("used")).where("used > capacity_tokens")
    whole = inside.groupBy(*size, "doc_id").agg(F.sum("piece_tokens").alias("placed"), F.count("*").alias("cuts"), F.min("piece_start").alias("first"), F.max(F.col("piece_start") + F.col("piece_tokens")).alias("last")).join(items, "doc_id")
    wrong = whole.where("placed <> n_tokens or first <> 0 or last <> n_tokens or cuts <> ceil(n_tokens / capacity_tokens)")
    out = pieces.groupBy(*size).agg(F.countDistinct(F.when(F.col("pack_id").isNotNull(), F.col("doc_id"))).alias("placed"), F.countDistinct(F.when(F.col("pack_id").isNull(), F.col("doc_id"))).alias("empty"))
    for name, bad in (("overfull", full), ("overlaps", clash), ("wrong_pieces", wrong)):
        out = out.join(bad.groupBy(*size).agg(F.count("*").alias(name)), size, "left")
    return out.fillna(0, ["overfull", "overlaps", "wrong_pieces"])


def queries() -> dict:
    return {"p8_packs": p8_packs, "p8_fill": p8_fill, "p8_checks": p8_checks}


SQL = {"p8_checks": "SELECT pack_name, CAST(capacity_tokens AS INTEGER) AS capacity_tokens, count(*) FILTER (WHERE d.text <> '') AS placed, count(*) FILTER (WHERE d.text IS NULL OR d.text = '') AS empty, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS wrong_pieces FROM documents d, pack_sizes WHERE capacity_tokens > 0 GROUP BY 1, 2"}


def oracle_sql() -> dict[str, str]:
    return SQL
