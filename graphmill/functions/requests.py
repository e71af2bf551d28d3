"""What an ingress needs of a raw request: body, form, address, signatures and fallbacks for broken JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphmill.functions.hashing import hmac_sha1
from graphmill.functions.payload import form_fields, opened


def raw_body(body: Column, is_base64: Column) -> Column:
    """The body as text; a flagged one is decoded first, and one that can't be decoded is null."""
    decoded = F.try_validate_utf8(F.try_to_binary(body, F.lit("base64")).cast("string"))
    return F.when(F.coalesce(is_base64, F.lit(False)), decoded).otherwise(body)


def form_json(body: Column) -> Column:
    """The JSON (variant) in the ``payload`` field of a form; without one, or with a broken one, an empty object."""
    return F.coalesce(opened(F.nullif(F.try_element_at(form_fields(body), F.lit("payload")), F.lit(""))), F.parse_json(F.lit("{}")))


def sorted_form(fields: Column) -> Column:
    """Keys and values of a form run together in the order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], e["value"])), "")


def vendor_signature(secret: str, url: Column, fields: Column) -> Column:
    """Base64 HMAC-SHA1 over the address and the sorted form; null without an address, so that a check fails."""
    return F.base64(F.unhex(hmac_sha1(secret, F.encode(F.concat(url, sorted_form(fields)), "UTF-8"))))


def request_url(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    """Address of a request as its sender saw it; https unless a proxy says otherwise, blanks escaped."""
    tail = F.coalesce(F.concat(F.lit("?"), F.nullif(query, F.lit(""))), F.lit(""))
    return F.replace(F.concat(F.coalesce(F.nullif(scheme, F.lit("")), F.lit("https")), F.lit("://"), host, path, tail), F.lit(" "), F.lit("%20"))


def query_orders(pairs: Column) -> Column:
    """All orders of a request's few ``k=v`` parts, each joined by ``&``, for senders whose order was lost.

    Orders grow by inserting each part at every place of those so far; the result has n! entries.
    """
    start = F.array(F.array().cast("array<string>"))
    grown = lambda acc, p: F.flatten(F.transform(acc, lambda a: F.transform(F.sequence(F.lit(0), F.size(a)), lambda i: F.concat(F.slice(a, 1, i), F.array(p), F.slice(a, i + 1, F.size(a))))))
    return F.transform(F.aggregate(F.coalesce(pairs, F.array().cast("array<string>")), start, grown), lambda a: F.array_join(a, "&"))


def stream_reply(url: Column, token: Column) -> Column:
    """Fixed value: the answer that connects a call to a media stream."""
    text = '<?xml version="1.0" encoding="UTF-8"?>\n<Response>\n    <Connect>\n        <Stream url="%s">\n            <Parameter name="auth_token" value="%s"/>\n        </Stream>\n    </Connect>\n</Response>'
    return F.format_string(text, url, token)


def notification(data: Column) -> Column:
    """JSON text of a base64 notification; what is no JSON comes as ``{"raw": text}``, null stays null."""
    text = F.make_valid_utf8(F.try_to_binary(data, F.lit("base64")).cast("string"))
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.when(text.isNotNull(), F.to_json(F.struct(text.alias("raw")))))


def setting_map(value: Column) -> Column:
    """A setting that is a JSON object as map<string,string>; anything else is an empty map."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))
    return F.coalesce(F.when(is_object, F.from_json(value, "map<string,string>")), F.from_json(F.lit("{}"), "map<string,string>"))


def status_from_broken(body: Column) -> Column:
    """Transition status by pattern from a body that is no JSON: the target status, else the current one, else empty."""
    found = lambda p: F.nullif(F.regexp_extract(body, p, 1), F.lit(""))
    return F.coalesce(found(r'"to_status"\s*:\s*"([^"]+)"'), found(r'"status"\s*:\s*\{\s*"name"\s*:\s*"([^"]+)"'), F.lit(""))


def issue_number(payload: Column) -> Column:
    """Number of the pull request, else of the issue, as text; else null."""
    at = lambda p: F.nullif(F.try_variant_get(payload, p, "string"), F.lit(""))
    return F.coalesce(at("$.pull_request.number"), at("$.issue.number"))


def without_keys(fields: Column, *keys: str) -> Column:
    """A map without some keys, such as a verification token."""
    return F.map_filter(fields, lambda k, _: ~k.isin(*keys))


def may_retry(status: Column) -> Column:
    """Whether a failed call may succeed later: all but client errors, of which 429 may; an unknown status may."""
    return ~F.coalesce((status >= 400) & (status < 500) & (status != 429), F.lit(False))
