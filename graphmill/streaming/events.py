"""Event plane: one column pipeline for batch and stream, deduplication, routing and consumption."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.hashing import chat_signature, fresh, host_signature
from graphmill.functions.paths import email_domain
from graphmill.functions.payload import INTERACTIONS, channel_of, chat_event_type, form_fields, host_event_type, opened, text_at, tracker_event_type
from graphmill.functions.requests import form_json, raw_body, vendor_signature

PROVIDERS = ["slack", "github", "jira", "twilio"]


def event_type(source: Column, payload: Column, host_event: Column, form: Column | None = None) -> Column:
    """Canonical event type of a payload (variant) by its provider; a text message's by its channel."""
    chat = chat_event_type(F.coalesce(text_at(payload, "$.event.type"), text_at(payload, "$.type")))
    host = host_event_type(host_event, text_at(payload, "$.action"), F.try_variant_get(payload, "$.pull_request.merged", "boolean"))
    tracker = tracker_event_type(text_at(payload, "$.event_type"), text_at(payload, "$.webhookEvent"), text_at(payload, "$.issue_event_type_name"))
    sms = F.lit("sms.received") if form is None else F.concat(channel_of(F.coalesce(F.try_element_at(form, F.lit("From")), F.lit(""))), F.lit(".received"))
    return F.when(source == "slack", chat).when(source == "github", host).when(source == "jira", tracker).when(source == "twilio", sms)


def normalize(requests: DataFrame, routes: DataFrame, secrets: dict[str, str], form_address: str | None = None) -> DataFrame:
    """``requests(request_id, provider_slug, headers, query, body, is_base64, received_at)`` -> status, route and event.

    Unknown provider 404, bad signature 401, broken body 400, challenge 200, unresolved tenant 400 (200
    for chat, which would retry), forwarded interactions 200, events 200 (204 for text messages).

    ``secrets`` holds a provider's signing secret; a provider without one refuses all, and text messages,
    which sign the address they were sent to and their sorted form, are refused without ``form_address``.
    Chat and text messages are routed by ``routes(event_source, workspace_key, tenant_id)``; the code host
    names its tenant in a header and the tracker in its query. Chat sends interactions as a form. Works on
    a stream as on a table.
    """
    h = lambda n: F.try_element_at("headers", F.lit(n))
    slug, body, form = F.col("provider_slug"), F.col("text"), F.col("form")
    r = requests.withColumn("text", raw_body(F.col("body"), F.col("is_base64")))
    r = r.withColumn("form", F.when(slug == "twilio", form_fields(F.col("text"))))
    boxed = (slug == "slack") & F.coalesce(F.col("text").startswith("payload="), F.lit(False))
    r = r.withColumn("v", F.when(boxed, form_json(F.col("text"))).otherwise(opened(F.col("text"))))
    sealed = F.coalesce(body, F.lit(""))
    checks = {
        "slack": (chat_signature(secrets["slack"], h("x-slack-request-timestamp"), sealed) == h("x-slack-signature")) & fresh(F.col("received_at"), h("x-slack-request-timestamp")) if "slack" in secrets else F.lit(False),
        "github": host_signature(secrets["github"], sealed) == h("x-hub-signature-256") if "github" in secrets else F.lit(False),
        "jira": h("x-jira-webhook-secret") == F.lit(secrets.get("jira")),
        "twilio": vendor_signature(secrets["twilio"], F.lit(form_address), form) == h("x-twilio-signature") if "twilio" in secrets and form_address else F.lit(False),
    }
    ok = F.lit(False)
    for name, check in checks.items():
        ok = F.when(slug == name, F.coalesce(check, F.lit(False))).otherwise(ok)
    said = F.nullif(F.trim(F.when(slug == "github", h("x-tenant-id")).when(slug == "jira", F.try_element_at("query", F.lit("tenant_id")))), F.lit(""))
    key = F.when(slug == "slack", F.coalesce(text_at(F.col("v"), "$.team_id"), text_at(F.col("v"), "$.team.id"))).when(slug == "twilio", F.try_element_at(form, F.lit("To")))
    d = routes.select(F.col("event_source").alias("provider_slug"), F.col("workspace_key").alias("ws"), F.col("tenant_id").alias("routed")).dropDuplicates(["provider_slug", "ws"])
    r = r.withColumns({"valid": ok, "said": said, "ws": key}).join(d, ["provider_slug", "ws"], "left").withColumn("tenant_id", F.coalesce("said", F.when(slug.isin("slack", "twilio"), F.col("routed"))))
    challenge = (slug == "slack") & F.coalesce(text_at(F.col("v"), "$.type") == "url_verification", F.lit(False))
    status = (
        F.when(~slug.isin(PROVIDERS) | slug.isNull(), 404)
        .when(~F.col("valid"), 401)
        .when(F.col("v").isNull() & (slug != "twilio"), 400)
        .when(challenge, 200)
        .when(F.col("tenant_id").isNull(), F.when(slug == "slack", 200).otherwise(400))
        .when(slug == "twilio", 204)
        .otherwise(200)
    )
    route = F.when(status >= 400, "reject").when(challenge, "challenge").when(F.col("tenant_id").isNull(), "drop").when((slug == "slack") & text_at(F.col("v"), "$.type").isin(INTERACTIONS), "forward").otherwise("publish")
    return r.select("request_id", "provider_slug", status.alias("status"), route.alias("route"), F.when(status < 400, F.col("tenant_id")).alias("tenant_id"), F.when(route == "publish", event_type(slug, F.col("v"), h("x-github-event"), form)).alias("event_type"))


def ttl_dedup(events: DataFrame, key: str, at: str, ttl_seconds: int = 300) -> DataFrame:
    """Sightings that are kept: the first of a key, and any later than the last kept one by more than the TTL.

    Repeats don't extend a key's time. Instants of a key are folded in order; a key with many
    sightings is first cut at gaps above the TTL, across which a fold always restarts.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(at)
    t = events.select(key, at).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    gap = F.unix_micros(F.col(at)) - F.unix_micros(F.lag(at).over(w)) > ttl_seconds * 1_000_000
    runs = t.withColumn("run", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w))
    folded = runs.groupBy(key, "run").agg(F.sort_array(F.collect_list(F.unix_micros(F.col(at)))).alias("ts"))
    keep = F.aggregate("ts", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) > ttl_seconds * 1_000_000), F.concat(acc, F.array(x))).otherwise(acc))
    return folded.select(key, F.explode(keep).alias("us")).select(key, F.timestamp_micros("us").alias(at))


def ttl_dedup_stream(events: DataFrame, key: str, at: str, ttl_seconds: int = 300, late_seconds: int = 600) -> DataFrame:
    """The same on a stream: one state per key, which expires once the watermark has passed its TTL.

    ``late_seconds`` is how far the watermark trails the newest event; later rows are dropped.
    """
    schema = f"{key} string, {at} timestamp"

    def fold(k, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for f in frames for t in f[at]):
            now = int(pd.Timestamp(t).timestamp() * 1_000_000)
            if last is None or now - last > ttl_seconds * 1_000_000:
                last = now
                out.append((k[0], t))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, at])

    src = events.select(F.col(key).cast("string").alias(key), at).where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, f"{late_seconds} seconds")
    return src.groupBy(key).applyInPandasWithState(fold, schema, "last bigint", "append", "EventTimeTimeout")


def sender_filter(mails: DataFrame, sender: str, blocked: list[str], blocked_domains: list[str], allowed: list[str], allowed_domains: list[str], allow_listed_only: bool) -> DataFrame:
    """Mails worth processing: blocked senders and domains first, then the allow lists if only they count."""
    who = F.lower(F.trim(F.col(sender)))
    dom = email_domain(who)
    has = lambda c, xs: F.coalesce(c.isin([x.lower() for x in xs]), F.lit(False)) if xs else F.lit(False)
    ok = F.coalesce(F.col(sender) != "", F.lit(False)) & ~has(who, blocked) & ~has(dom, blocked_domains)
    return mails.where(ok & (has(who, allowed) | has(dom, allowed_domains)) if allow_listed_only else ok)


def ack_outcome(body_ok: Column, has_id: Column, error: Column, keep_poison: bool = False) -> Column:
    """``acked``, ``dead_letter`` or ``retry`` of a consumed message; chat consumers keep poison messages."""
    bad = F.lit("retry" if keep_poison else "dead_letter")
    return F.when(~body_ok | ~has_id, bad).when(error.isNull(), "acked").when((error == "auth") & F.lit(not keep_poison), "dead_letter").otherwise("retry")


def publish_by_tenant(events: DataFrame, path: str, checkpoint: str):
    """Streaming sink: one folder per tenant, each micro-batch written once."""
    return events.writeStream.format("parquet").partitionBy("tenant_id").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
