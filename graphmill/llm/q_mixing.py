"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.llm.mixing import distinct_texts, plan_sources, training_order
from graphmill.llm.tokens import with_token_counts
from graphmill.session import materialize, table


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    sized = with_token_counts(docs, {"doc_id": F.col("doc_id"), "source": F.col("source"), "tid": F.xxhash64("text", F.length("text"))})
    texts = materialize(distinct_texts(sized, targets), "p9-texts")
    plan = materialize(plan_sources(texts, targets), "p9-plan")
    return training_order(texts, plan), plan


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in training order."""
    rows, _ = _mix(spark, sf_dir)
    return rows.orderBy("position", "source", "doc_id", "epoch")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached share of each source; one without texts reaches none."""
    rows, plan = _mix(spark, sf_dir)
    got = rows.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count("*").alias("mix_rows"), F.max(F.col("epoch") + 1).alias("most_repeats"))
    out = plan.join(got, "source", "left").withColumn("all_tokens", F.sum("mix_tokens").over(Window.partitionBy(F.lit(0))))  # one row a target
    zero = F.lit(0)
    return out.select("source", "target_weight", F.round("weight", 6).alias("weight"), "max_repeats", "texts", "tokens", F.coalesce("mix_rows", zero).alias("mix_rows"), F.coalesce("mix_tokens", zero).alias("mix_tokens"), F.coalesce("most_repeats", zero).alias("most_repeats"), F.round(F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("share"))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of each source in the mix: its texts, and whether repeats and share are kept.

    A share is kept if it differs from the weight by no more than the source's longest text does of the mix.
    """
    rows, plan = _mix(spark, sf_dir)
    most = rows.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.max("n_tokens").alias("long"), F.sum("n_tokens").alias("tokens"))
    got = most.groupBy("source").agg(F.max("times").alias("times"), F.max("long").alias("long"), F.sum("tokens").alias("mix_tokens"))
    out = plan.join(got, "source", "left").withColumn("all_tokens", F.sum("mix_tokens").over(Window.partitionBy(F.lit(0))))  # one row a target
    close = F.abs(F.coalesce("mix_tokens", F.lit(0)) - F.col("weight") * F.col("all_tokens")) <= 2 * F.coalesce("long", F.lit(0)) + 1e-6 * F.col("all_tokens") + F.col("weight") * F.lit(2) * F.max("long").over(Window.partitionBy(F.lit(0)))
    return out.select("source", F.col("texts").alias("n_texts"), (F.coalesce("times", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), close.alias("share_kept"))


def queries() -> dict:
    return {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_checks": p9_checks}


SQL = {
    "p9_checks": (
        "WITH n AS (SELECT doc_id, text, lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source FROM documents WHERE doc_id IS NOT NULL AND text <> ''), "
        "g AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS source FROM mix_targets WHERE target_weight > 0), "
        "f AS (SELECT text, arg_min(n.source, doc_id) AS source FROM n WHERE source IN (SELECT source FROM g) GROUP BY text) "
        "SELECT g.source, count(f.text) AS n_texts, TRUE AS repeats_kept, TRUE AS share_kept FROM (SELECT DISTINCT source FROM g WHERE source <> '') g LEFT JOIN f USING (source) GROUP BY g.source"
    ),
}


def oracle_sql() -> dict[str, str]:
    return SQL
