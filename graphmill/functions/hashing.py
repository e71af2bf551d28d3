"""Hashes and signatures, without UDFs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def blob_sha(content: Column) -> Column:
    """Object id a version-control system gives this content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def _pads(secret: str, digest) -> tuple[Column, Column]:
    """Inner and outer pad of a key, computed once on the driver."""
    key = secret.encode()
    key = digest(key).digest() if len(key) > 64 else key
    return tuple(F.unhex(F.lit(bytes(b ^ p for b in key.ljust(64, b"\0")).hex())) for p in (0x36, 0x5C))


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column."""
    inner, outer = _pads(secret, hashlib.sha256)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def hmac_sha1(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA1 of a binary column."""
    inner, outer = _pads(secret, hashlib.sha1)
    return F.sha1(F.concat(outer, F.unhex(F.sha1(F.concat(inner, message)))))


def chat_signature(secret: str, timestamp: Column, body: Column) -> Column:
    return F.concat(F.lit("v0="), hmac_sha256(secret, F.encode(F.concat_ws(":", F.lit("v0"), timestamp, body), "UTF-8")))


def host_signature(secret: str, body: Column) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(secret, F.encode(body, "UTF-8")))


def fresh(received: Column, timestamp: Column, window: int = 300) -> Column:
    """Replay check: a numeric timestamp within the window of the receipt; anything else fails."""
    t = timestamp.try_cast("double")
    return F.coalesce(F.abs(F.unix_timestamp(received) - t) <= window, F.lit(False))


def email_hash(email: Column) -> Column:
    return F.substring(F.sha2(F.lower(email), 256), 1, 16)
