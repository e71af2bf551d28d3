"""Mail messages as landed JSON: bodies, attachments and the message a history points at."""

import base64
import binascii
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = "struct<plain:string,html:string,attachments:array<struct<filename:string,attachment_id:string>>>"


def _decoded(data: str) -> str | None:
    try:
        return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8")
    except (binascii.Error, ValueError):
        return None


def parts_of(payload: str | None) -> dict | None:
    """First plain and first HTML text and all attachments of a message's part tree, in document order."""
    try:
        root = json.loads(payload) if payload else None
    except ValueError:
        return None
    if not isinstance(root, dict):
        return None
    out = {"plain": None, "html": None, "attachments": []}
    todo = [(root, True)]
    while todo:
        part, is_root = todo.pop()
        body = part.get("body") if isinstance(part.get("body"), dict) else {}
        kind = {"text/plain": "plain", "text/html": "html"}.get(part.get("mimeType"))
        if kind and body.get("data") and not out[kind]:
            out[kind] = _decoded(body["data"])
        if not is_root and part.get("filename") and body.get("attachmentId"):
            out["attachments"].append({"filename": part["filename"], "attachment_id": body["attachmentId"]})
        children = part.get("parts") if isinstance(part.get("parts"), list) else []
        todo += [(p, False) for p in reversed(children) if isinstance(p, dict)]
    return out


def mail_parts(payload: Column) -> Column:
    """``plain``, ``html`` and ``attachments`` of a message's JSON payload; broken JSON gives nulls."""

    def walk(payload: pd.Series) -> pd.DataFrame:
        empty = {"plain": None, "html": None, "attachments": None}
        return pd.DataFrame([parts_of(p) or empty for p in payload], columns=list(empty))

    return F.pandas_udf(walk, PARTS)(payload)


def new_message_id(history: Column, latest: Column) -> Column:
    """Last message of the first history record that added any, else the newest inbox message.

    ``history`` is the JSON text of the records; broken JSON counts as no records.
    """
    records = F.from_json(history, "array<struct<messagesAdded:array<struct<message:struct<id:string>>>>>")
    added = F.filter(F.coalesce(records, F.from_json(F.lit("[]"), "array<struct<messagesAdded:array<struct<message:struct<id:string>>>>>")), lambda r: F.size(r["messagesAdded"]) > 0)
    return F.coalesce(F.element_at(F.get(added, F.lit(0))["messagesAdded"], -1)["message"]["id"], latest)
