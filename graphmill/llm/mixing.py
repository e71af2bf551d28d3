"""Sources mixed to target weights along a curriculum.

A source's weight over training time ``t`` in 0..1 is ``target * (1 + tilt * (1 - 2t))``; tilts are
scaled so that the weights sum to one at every moment, and each integrates to its target. The
integral is the source's cumulative token demand; inverted at a text's cumulative tokens it gives the
text's training position. Prefix sums run in two levels (many even buckets per source, then sums of
buckets), so a source with a third of all rows is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_name(c):
    """Source names without letter case and surrounding blanks; blank is null."""
    x = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(x != "", x)


def plan_sources(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, curriculum: float = 0.8) -> DataFrame:
    """One row per target source: ``(source, target_weight, weight, max_repeats, texts, tokens, demand, tilt, total)``.

    ``weight`` is the target shared out among sources that have tokens. The size of the mix is the
    largest at which every such source reaches its weight within its repeats, or ``total_tokens``: then a
    source gives what its repeats allow and may fall short of its weight, as the reached shares tell. The
    tilt prefers sources with short texts early.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats")).where("source is not null and target_weight > 0")
    t = t.groupBy("source").agg(F.sum("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    have = texts.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))
    s = t.join(have, "source", "left").withColumns({"texts": F.coalesce("texts", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    every = Window.partitionBy(F.lit(0))  # over the target table, which is tiny
    live = F.col("tokens") > 0
    s = s.withColumn("weight", F.when(live, F.col("target_weight") / F.sum(F.when(live, F.col("target_weight"))).over(every)).otherwise(0.0))
    s = s.withColumn("most", F.min(F.when(live, F.col("max_repeats") * F.col("tokens") / F.col("weight"))).over(every))
    most = F.col("most") if total_tokens is None else F.lit(float(total_tokens))
    s = s.withColumn("demand", F.coalesce(F.least(F.col("weight") * most, (F.col("max_repeats") * F.col("tokens")).cast("double")), F.lit(0.0)))
    rank = Window.partitionBy(F.lit(0)).orderBy(F.when(live, F.col("tokens") / F.col("texts")).otherwise(0.0), "source")
    s = s.withColumn("z", F.percent_rank().over(rank))
    s = s.withColumn("tilt", F.lit(curriculum) * (F.sum(F.col("weight") * F.col("z")).over(every) - F.col("z")))
    s = s.withColumn("total", F.sum("demand").over(every))
    return s.select("source", "target_weight", "weight", "max_repeats", "texts", "tokens", "demand", "tilt", "total")


def training_order(texts: DataFrame, plan: DataFrame, seed: int = 1, bucket_rows: int = 20_000) -> DataFrame:
    """``texts(doc_id, source, tid, n_tokens)``, one row per text -> ``(position, source, doc_id, epoch, n_tokens)``.

    A source's texts follow in pseudo-random order, the whole order again in each further epoch, until
    its demand is met; a text enters if at least half of it still fits. ``position`` runs over tokens
    of the whole mix.
    """
    t = texts.join(plan.select("source", "max_repeats", F.col("texts").alias("texts_all"), F.col("tokens").alias("all"), "demand", "tilt", "total"), "source").where("n_tokens > 0")
    h = F.xxhash64("tid", F.lit(seed))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("texts_all") / F.lit(bucket_rows)))
    t = t.withColumns({"h": h, "b": F.pmod(h, buckets)})
    sums = t.groupBy("source", "b").agg(F.sum("n_tokens").alias("s"))
    sums = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("b")) - F.col("s")).drop("s")
    inside = Window.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("own", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(sums, ["source", "b"])
    epochs = F.least(F.col("max_repeats").cast("bigint"), F.ceil(F.col("demand") / F.col("all")))
    t = t.where("demand > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (epochs - 1).cast("int"))))
    mid = F.col("epoch") * F.col("all") + F.col("before") + F.col("own") + F.col("n_tokens") / 2
    t = t.withColumn("share", mid / F.col("demand")).where("share <= 1")
    a = F.col("tilt")
    root = ((1 + a) - F.sqrt(F.greatest(F.lit(0.0), (1 + a) * (1 + a) - 4 * a * F.col("share")))) / (2 * a)
    time = F.when(F.abs(a) < 1e-9, F.col("share")).otherwise(root)
    return t.select(F.floor(time * F.col("total")).cast("bigint").alias("position"), "source", "doc_id", "epoch", "n_tokens")


def distinct_texts(docs: DataFrame, plan_names: DataFrame) -> DataFrame:
    """One row per text among the target sources: a repost does not raise a text's repeats.

    ``docs(doc_id, source, tid, n_tokens)``; the smallest ``doc_id`` stands for the text and names its
    source. Texts without tokens, ids or a target source are left out.
    """
    d = docs.where("n_tokens > 0 and doc_id is not null").withColumn("source", source_name(F.col("source"))).join(plan_names.select(source_name(F.col("source")).alias("source")).distinct(), "source", "left_semi")
    return d.groupBy("tid").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.doc_id", "d.source", "tid", "d.n_tokens")
