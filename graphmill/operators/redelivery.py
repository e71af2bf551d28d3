"""Messages delivered more than once: an incremental store that keeps one delivery of each message.

State on the shared file system:

* ``parts/``   one folder per rewritten partition version; a partition is the UTC day of a message's winner
* ``index/``   segments ``(key, label, day)``: identifier -> message -> the partition that holds it
* ``manifest-<n>.json``   partition -> folder, and the valid index segments; version ``n`` becomes
  current by one rename, so a reader sees either the old or the new state

``apply`` looks the incoming identifiers up in the index, reads only the partitions that hold the
messages found, recomputes single winners over old winners and incoming deliveries together, and
writes new folders for only those partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators.components import connected_components
from graphmill.session import Files, materialize

#: Spellings that are no identifier.
NO_ID = ["", "null", "undefined"]


def provider_id(c: Column) -> Column:
    """Identifier without letter case and surrounding blanks; null where it means nothing."""
    clean = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(~clean.isin(NO_ID), clean)


def instant(c: Column) -> Column:
    """ISO 8601 text with or without fraction, ``T`` or blank, any offset spelling -> instant; else null."""
    t = F.upper(F.trim(c))
    t = F.regexp_replace(t, r"^(\d{4})(\d\d)(\d\d)T", "$1-$2-$3T")
    t = F.regexp_replace(t, r"T(\d\d)(\d\d)(\d\d)", "T$1:$2:$3")
    t = F.regexp_replace(t, r"(\d),(\d)", "$1.$2")
    t = F.regexp_replace(t, r"\s*([+-]\d\d)(\d\d)$", "$1:$2")
    t = F.regexp_replace(t, r"(:\d\d(?:\.\d+)?)\s+([+-Z])", "$1$2")
    return F.try_to_timestamp(t) if not hasattr(Column, "try_cast") else t.try_cast("timestamp")


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def delivery_keys(df: DataFrame) -> DataFrame:
    """``(delivery_id, at, own, k_event, k_provider)``: what identifies each delivery.

    A null ``event_id`` and a provider id without meaning identify nothing; so does a provider id
    without source or tenant. A delivery without any identifier is its own message. ``at`` is null
    (sorted last) where ``received_at`` cannot be read.
    """
    pid = provider_id(F.col("provider_event_id"))
    return df.select(
        "delivery_id",
        instant(F.col("received_at")).alias("at"),
        F.when(F.col("event_id").isNotNull(), _digest(F.lit("e"), F.col("event_id"))).alias("k_event"),
        F.when(pid.isNotNull() & F.col("event_source").isNotNull() & F.col("tenant_id").isNotNull(), _digest(F.lit("p"), F.col("event_source"), F.col("tenant_id"), pid)).alias("k_provider"),
        _digest(F.lit("d"), F.col("delivery_id").cast("string")).alias("own"),
    )


def _order(at: str = "at") -> Column:
    """Earliest instant first, unreadable instants last, then the smallest delivery."""
    return F.struct(F.col(at).isNull().alias("late"), F.col(at).alias("at"), F.col("delivery_id").alias("delivery_id"))


class MessageStore:
    """One winner per message, kept up to date batch by batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def manifest(self) -> dict:
        versions = sorted(int(n[9:-5]) for n in self.files.names(self.root) if n.startswith("manifest-"))
        return self.files.read_json(f"{self.root}/manifest-{versions[-1]}.json") if versions else {"version": 0, "parts": {}, "index": []}

    PART = "label binary, delivery_id bigint, at timestamp, day string"
    INDEX = "key binary, label binary, day string, version bigint"

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def winners(self) -> DataFrame:
        """Current winners ``(label, delivery_id, at, day)``."""
        return self._read(sorted(self.manifest()["parts"].values()), self.PART)

    def apply(self, incoming: DataFrame) -> None:
        """Merge a batch of deliveries; repeats inside the batch and against history both count."""
        state = self.manifest()
        keys = materialize(delivery_keys(incoming), "p7-keys")
        start = F.coalesce("k_event", "k_provider", "own")
        known = None
        links = keys.where("k_event is not null and k_provider is not null").select(F.col("k_event").alias("u"), F.col("k_provider").alias("v"))
        if state["index"]:
            index = self._read(state["index"], self.INDEX)
            wanted = keys.select(F.explode(F.array("k_event", "k_provider", "own")).alias("key")).where("key is not null").distinct()
            hits = index.join(wanted, "key", "left_semi").groupBy("key").agg(F.max_by(F.struct("label", "day"), "version").alias("x")).select("key", "x.label", "x.day")
            known = materialize(hits, "p7-hits")
            links = links.unionByName(known.select(F.col("key").alias("u"), F.col("label").alias("v")))
        links = materialize(links.distinct(), "p7-links")
        # Only identifiers that share a neighbour with others need rounds; lone pairs are labelled here.
        labels = connected_components(_knotted(links))
        pair = links
        simple = pair.select(F.col("u").alias("node"), F.least("u", "v").alias("label")).unionByName(pair.select(F.col("v").alias("node"), F.least("u", "v").alias("label")))
        simple = simple.join(labels.select("node"), "node", "left_anti").groupBy("node").agg(F.min("label").alias("label"))
        label = materialize(labels.unionByName(simple), "p7-labels")
        inc = keys.withColumn("node", start).join(label, "node", "left").select(F.coalesce("label", "node").alias("label"), "delivery_id", "at", "k_event", "k_provider", "own")
        touched = None
        pool = inc.select("label", "delivery_id", "at")
        days: list[str] = []
        if known is not None:
            touched = known.select(F.col("label").alias("old"), "day").distinct()
            days = [r[0] for r in touched.select("day").distinct().collect()]  # names of partitions, no rows
            old = self._read([state["parts"][d] for d in days if d in state["parts"]], self.PART)
            old = old.join(touched.select(F.col("old").alias("label")).distinct(), "label", "left_semi").withColumnRenamed("label", "node")
            pool = pool.unionByName(old.join(label, "node", "left").select(F.coalesce("label", "node").alias("label"), "delivery_id", "at"))
        best = pool.groupBy("label").agg(F.min(_order()).alias("w")).select("label", "w.delivery_id", "w.at", F.coalesce(F.date_format("w.at", "yyyy-MM-dd"), F.lit("unknown")).alias("day"))
        best = materialize(best, "p7-winners")
        # Partitions to rewrite: those of touched messages and those that receive a winner.
        fresh = [r[0] for r in best.select("day").distinct().collect()]
        rewrite = sorted(set(days) | set(fresh))
        rows = best
        if state["parts"]:
            keep = self._read([state["parts"][d] for d in rewrite if d in state["parts"]], self.PART)
            rows = rows.unionByName(keep.join(touched.select(F.col("old").alias("label")).distinct(), "label", "left_anti"))
        version = state["version"] + 1
        out = f"{self.root}/parts/v{version}-{uuid.uuid4().hex}"
        # One folder a day; a large day is split over several files by its labels.
        rows.withColumn("d", F.col("day")).repartition("d", F.pmod(F.hash("label"), F.lit(4))).write.partitionBy("d").parquet(out)
        parts = {d: p for d, p in state["parts"].items() if d not in rewrite}
        written = {n[2:] for n in self.files.names(out) if n.startswith("d=")}
        parts |= {d: f"{out}/d={d}" for d in rewrite if d in written}
        seg = f"{self.root}/index/v{version}-{uuid.uuid4().hex}"
        own = inc.select("label", F.explode(F.array("k_event", "k_provider", "own")).alias("key")).where("key is not null").select("key", "label").distinct()
        if known is not None:
            # Identifiers of merged messages follow their message to its new label and partition.
            moved = self._read(state["index"], self.INDEX).groupBy("key").agg(F.max_by("label", "version").alias("node"))
            moved = moved.join(touched.select(F.col("old").alias("node")).distinct(), "node", "left_semi").join(label, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
            own = own.unionByName(moved).distinct()
        own.join(best.select("label", "day"), "label").select("key", "label", "day", F.lit(version).cast("bigint").alias("version")).write.parquet(seg)
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        self.files.write_json(draft, {"version": version, "parts": parts, "index": [*state["index"], seg], "rewrote": rewrite})
        if not self.files.rename(draft, f"{self.root}/manifest-{version}.json"):
            raise RuntimeError("another writer published this version first")


def _knotted(links: DataFrame) -> DataFrame:
    """Links in a component of three or more identifiers: one end has another link."""
    busy = links.select(F.col("u").alias("n")).unionByName(links.select(F.col("v").alias("n"))).groupBy("n").count().where("count > 1").select("n")
    return links.join(busy.withColumnRenamed("n", "u"), "u", "left_semi").unionByName(links.join(busy.withColumnRenamed("n", "v"), "v", "left_semi")).distinct()


def repeated_deliveries(deliveries: DataFrame, root: str, recent_batches: int = 3) -> DataFrame:
    """``(delivery_id)`` of the deliveries to drop, through a store at ``root``.

    Batches before the last ``recent_batches`` are loaded as history, the rest comes in as one batch.
    A null batch number counts as history. Repeated rows with one ``delivery_id`` are one delivery.
    Empty input gives no rows.
    """
    spark = deliveries.sparkSession
    store = MessageStore(spark, root)
    last = deliveries.agg(F.max("batch_no")).first()[0]
    if last is not None:
        recent = F.coalesce(F.col("batch_no") > F.lit(last - recent_batches), F.lit(False))
        store.apply(deliveries.where(~recent))
        store.apply(deliveries.where(recent))
    else:
        store.apply(deliveries)
    return deliveries.select("delivery_id").where("delivery_id is not null").distinct().join(store.winners().select("delivery_id"), "delivery_id", "left_anti")
