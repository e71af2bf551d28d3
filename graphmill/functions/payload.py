"""Provider payloads: field access, event types, channels and rich text."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphmill.functions.paths import literal_map

#: Event types of the chat, code host and tracker providers.
CHAT_EVENTS = {"app_mention": "app_mention.received", "message": "message.created", "reaction_added": "reaction.added", "reaction_removed": "reaction.removed", "member_joined_channel": "member_joined_channel.received", "member_left_channel": "member_left_channel.received", "channel_created": "channel.created", "channel_rename": "channel.renamed", "channel_archive": "channel.archived", "channel_unarchive": "channel.unarchived", "file_shared": "file.shared", "app_home_opened": "app_home.opened", "pin_added": "pin.added", "pin_removed": "pin.removed", "team_join": "team.joined"}
HOST_EVENTS = {"pull_request/opened": "pull_request.opened", "push/": "push.received", "issues/opened": "issue.opened", "issues/closed": "issue.closed"}
TRACKER_EVENTS = {"jira:issue_created": "issue.created", "jira:issue_deleted": "issue.deleted", "comment_created": "issue.commented", "comment_updated": "issue.commented", "comment_deleted": "issue.commented"}
TRACKER_UPDATES = {"issue_assigned": "issue.assigned", "issue_workflow": "issue.transitioned", "issue_generic": "issue.updated", "issue_commented": "issue.commented", "issue_comment_edited": "issue.commented"}
CHANNELS = {"whatsapp:": "whatsapp", "rcs:": "rcs"}
INTERACTIONS = ["block_actions", "view_submission", "view_closed", "shortcut", "message_action"]


def opened(body: Column) -> Column:
    """A JSON payload; one that is a JSON string is opened once, broken text gives null."""
    v = F.try_parse_json(body)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def chat_event_type(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(CHAT_EVENTS), kind), F.concat(kind, F.lit(".received")), F.lit("unknown.received"))


def host_event_type(event: Column, action: Column, merged: Column) -> Column:
    table = literal_map(HOST_EVENTS)
    known = F.coalesce(F.try_element_at(table, F.concat_ws("/", event, action)), F.try_element_at(table, F.concat(event, F.lit("/"))))
    done = (event == "pull_request") & (action == "closed") & F.coalesce(merged, F.lit(False))
    return F.when(done, F.lit("pull_request.merged")).otherwise(F.coalesce(known, F.concat_ws(".", event, F.coalesce(F.nullif(action, F.lit("")), F.lit("received")))))


def tracker_event_type(explicit: Column, event: Column, update: Column) -> Column:
    known = F.coalesce(F.try_element_at(literal_map(TRACKER_EVENTS), event), F.concat(F.nullif(event, F.lit("")), F.lit(".received")), F.lit("unknown.received"))
    changed = F.coalesce(F.try_element_at(literal_map(TRACKER_UPDATES), update), F.lit("issue.updated"))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(event == "jira:issue_updated", changed).otherwise(known))


def channel_of(address: Column) -> Column:
    out = F.lit("sms")
    for prefix, name in CHANNELS.items():
        out = F.when(address.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def bare_address(address: Column) -> Column:
    return F.regexp_replace(address, "^(" + "|".join(CHANNELS) + ")", "")


def _form_pairs(body: Column) -> Column:
    part = lambda p, i: F.coalesce(F.try_url_decode(F.coalesce(F.get(F.split(p, "=", 2), F.lit(i)), F.lit(""))), F.lit(""))
    return F.transform(F.filter(F.split(F.coalesce(body, F.lit("")), "&"), lambda p: p != ""), lambda p: F.struct(part(p, 0).alias("k"), part(p, 1).alias("v")))


def form_fields(body: Column, first: bool = False) -> Column:
    """URL-encoded form to map; blank values stay, ``+`` is a blank; the last of repeated keys wins, or the first."""
    kv = _form_pairs(body)
    kv = F.reverse(kv) if first else kv
    last = F.filter(kv, lambda e, i: ~F.exists(F.slice(kv, i + 2, F.size(kv) + 1), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def media_urls(fields: Column) -> Column:
    """``MediaUrl0..n-1`` of a message's fields, blanks dropped."""
    n = F.coalesce(F.try_element_at(fields, F.lit("NumMedia")).try_cast("int"), F.lit(0))
    seq = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    urls = F.transform(seq, lambda i: F.try_element_at(fields, F.concat(F.lit("MediaUrl"), i.cast("string"))))
    return F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != "")


def merged_fields(first: Column, later: Column) -> Column:
    """Two maps as one, the later's keys win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(first), lambda e: ~F.array_contains(F.map_keys(later), e["key"])), F.map_entries(later)))


def _leaves(document: str | None) -> str:
    """The ``text`` leaves of a JSON tree, joined in document order; broken JSON has none."""
    try:
        todo, out = [json.loads(document)] if document else [], []
    except ValueError:
        return ""
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += reversed(node)
        elif isinstance(node, dict):
            if isinstance(node.get("text"), str):
                out.append(node["text"])
            todo.append(node.get("content"))
    return "".join(out)


def rich_text(document: Column) -> Column:
    """Text of a rich-text document (``document`` is JSON text); null and broken JSON give an empty text.

    The tree has no bounded depth, so it is walked in Arrow batches; Java's patterns overflow on long texts.
    """

    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(_leaves)

    return F.pandas_udf(walk, "string")(document)


def transition_status(payload: Column) -> Column:
    """Status a tracker event leads to: its transition's, else that of the change log's status item, else the issue's, else empty."""
    items = F.coalesce(F.from_json(F.try_variant_get(payload, "$.changelog.items", "string"), "array<struct<field:string,toString:string>>"), F.from_json(F.lit("[]"), "array<struct<field:string,toString:string>>"))
    moved = F.get(F.filter(items, lambda i: i["field"] == "status"), F.lit(0))["toString"]
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(text_at(payload, "$.transition.to_status")), given(moved), text_at(payload, "$.issue.fields.status.name"), F.lit(""))


def run_id(text: Column, key: str) -> Column:
    """Id written as ``key=<36 hex digits and dashes>`` somewhere in a text, else null."""
    return F.nullif(F.regexp_extract(text, rf"(?<![A-Za-z0-9_]){key}=([a-f0-9-]{{36}})", 1), F.lit(""))


def fence_stripped(raw: Column) -> Column:
    """A model reply without a surrounding code fence."""
    return F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*|\s*```$", "")


def unpadded_base64(data: Column) -> Column:
    """URL-safe base64 to text."""
    std = F.translate(data, "-_", "+/")
    return F.decode(F.try_to_binary(F.concat(std, F.repeat(F.lit("="), F.pmod(-F.length(std), F.lit(4)))), F.lit("base64")), "UTF-8")
