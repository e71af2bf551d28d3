"""Decisions that other systems carry out, as rows: what to publish, store, trigger or skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.hashing import email_hash
from graphmill.functions.paths import slug

#: Fixed value: how many characters of a secret a subscription carries.
SECRET_CHARS = 20


def tenant_messages(events: DataFrame, pattern: str, env: str) -> DataFrame:
    """``events(..., tenant_id, provider_slug)`` with the queue they go to and their attributes.

    ``pattern`` names a tenant's queue by ``{env}`` and ``{tenant}``. Events without a tenant go nowhere.
    """
    before, after = pattern.replace("{env}", env).split("{tenant}")
    return events.where("tenant_id is not null").select("*", F.concat(F.lit(before), "tenant_id", F.lit(after)).alias("queue"), F.create_map(F.lit("provider_slug"), F.col("provider_slug")).alias("attributes"))


def mail_attributes(email: Column, tenant: Column, at: Column) -> Column:
    """The four attributes of a mail notification; the instant in whole seconds."""
    return F.create_map(F.lit("Email"), email, F.lit("Source"), F.lit("gmail"), F.lit("Timestamp"), F.unix_timestamp(at).cast("string"), F.lit("Tenant"), tenant)


def document_key(at: Column, title: Column) -> Column:
    """Object key of a rendered design: its instant and its title's slug."""
    return F.concat(F.lit("technical_designs/"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), slug(title), F.lit(".pdf"))


def attachment_key(file_name: Column) -> Column:
    """Object key of an attachment; the same name overwrites."""
    return F.concat(F.lit("attachments/"), file_name)


def agent_runs(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events joined to the agent their event name is mapped to: ``(event, agent_name, params)`` rows to run.

    ``events(event_name, ...)``, ``rules(event_name, agent_name)``, one rule a name (the smallest agent of
    several). Events without a rule trigger nothing.
    """
    one = rules.where("event_name is not null").groupBy("event_name").agg(F.min("agent_name").alias("agent_name"))
    return events.join(one, "event_name").select("*", F.to_json(F.struct(*[c for c in events.columns])).alias("params_json"))


def mailbox_actions(mails: DataFrame, label: str, archive: bool = False) -> DataFrame:
    """``mails(message_id)`` with the labels to set and to take away: read, labelled and, if wanted, archived."""
    gone = ["UNREAD", "INBOX"] if archive else ["UNREAD"]
    return mails.select("message_id", F.array(F.lit(label)).alias("add_labels"), F.array(*[F.lit(x) for x in gone]).alias("remove_labels"))


def skip_reasons(notifications: DataFrame, ttl_seconds: int = 300, mark_before_fetch: bool = True) -> DataFrame:
    """Each notification's reason to be skipped, or null: the first that holds of a fixed order.

    ``notifications(notification_id, state_ok, secret, expected_secret, message_id, at, fetched, sender,
    own_address, sender_hash)``. ``bad_state``, ``secret`` (only its first 20 characters travel),
    ``no_message``, ``repeat`` (within the TTL of the last one kept; repeats do not extend it),
    ``fetch_failed``, ``self_sent``, ``other_sender``. With ``mark_before_fetch`` a failed fetch also
    blocks later ones within the TTL, as the id is marked first; without it only fetched ones do.
    """
    n = notifications
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    early = (
        F.when(~F.coalesce("state_ok", F.lit(False)), "bad_state")
        .when(given("expected_secret") & (F.coalesce("secret", F.lit("")) != F.substring("expected_secret", 1, SECRET_CHARS)), "secret")
        .when(~given("message_id"), "no_message")
    )
    marks = early.isNull() if mark_before_fetch else early.isNull() & F.coalesce("fetched", F.lit(False))
    n = n.withColumns({"early": early, "marks": marks, "us": F.unix_micros(F.col("at").cast("timestamp"))})
    # Sightings of one message within gaps of the TTL are folded in order of arrival; a longer gap starts anew.
    order = Window.partitionBy("message_id").orderBy("us", "notification_id")
    live = n.where("early is null")
    gap = F.col("us") - F.lag("us").over(order) > ttl_seconds * 1_000_000
    live = live.withColumn("run", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(order))
    each = F.struct("us", "notification_id", "marks")
    folded = live.groupBy("message_id", "run").agg(F.array_sort(F.collect_list(each)).alias("seen"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("repeats"))

    def step(acc, s):
        repeat = F.coalesce(s["us"] - acc["last"] <= ttl_seconds * 1_000_000, F.lit(False))
        return F.struct(F.when(~repeat & s["marks"], s["us"]).otherwise(acc["last"]).alias("last"), F.when(repeat, F.concat(acc["repeats"], F.array(s["notification_id"]))).otherwise(acc["repeats"]).alias("repeats"))

    repeats = folded.select(F.explode(F.aggregate("seen", start, step)["repeats"]).alias("notification_id")).distinct().withColumn("again", F.lit(True))
    j = n.join(repeats, "notification_id", "left")
    late = (
        F.when(F.col("again"), "repeat")
        .when(~F.coalesce("fetched", F.lit(False)), "fetch_failed")
        .when(F.lower("sender") == F.lower("own_address"), "self_sent")
        .when(given("sender_hash") & ~F.coalesce(email_hash(F.col("sender")) == F.col("sender_hash"), F.lit(False)), "other_sender")
    )
    return j.select("notification_id", F.coalesce("early", late).alias("skip_reason"))


def cached_reads(reads: DataFrame, ttl_seconds: int = 300, refresh_on_error: bool = False) -> DataFrame:
    """What a value cache answers to each read ``(key, at, read_id, value, failed)``: ``(read_id, answer, source)``.

    The first read of a key and any later than the TTL after the last load goes to the store; in between
    the loaded value is answered (``cache``). A load that fails answers the stale value (``stale``) unless
    ``refresh_on_error``, or nothing (``error``) where none was loaded, and is tried again by the next read.
    """
    order = F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "read_id", "value", F.coalesce("failed", F.lit(False)).alias("failed"))))
    kept = "struct<us:bigint,value:string>"
    row = "struct<read_id:bigint,answer:string,source:string>"
    start = F.struct(F.lit(None).cast(kept).alias("kept"), F.array().cast(f"array<{row}>").alias("out"))

    def step(acc, r):
        hit = F.coalesce(r["us"] - acc["kept"]["us"] <= ttl_seconds * 1_000_000, F.lit(False))
        stale = F.lit(not refresh_on_error) & acc["kept"].isNotNull()
        answer = F.when(hit, acc["kept"]["value"]).when(~r["failed"], r["value"]).when(stale, acc["kept"]["value"])
        source = F.when(hit, "cache").when(~r["failed"], "store").when(stale, "stale").otherwise("error")
        now = F.when(~hit & ~r["failed"], F.struct(r["us"].alias("us"), r["value"].alias("value")).cast(kept)).otherwise(acc["kept"])
        return F.struct(now.alias("kept"), F.concat(acc["out"], F.array(F.struct(r["read_id"].alias("read_id"), answer.alias("answer"), source.alias("source")).cast(row))).alias("out"))

    return reads.groupBy("key").agg(order.alias("reads")).select(F.inline(F.aggregate("reads", start, step)["out"]))


def token_expiry(issued: Column, expires_in: Column, slack: int = 5) -> Column:
    """Instant until which an access token is used: its life less a few seconds; a missing life is none."""
    return F.timestamp_seconds(F.unix_timestamp(issued) + F.greatest(F.lit(0), F.coalesce(expires_in, F.lit(0)) - slack))
