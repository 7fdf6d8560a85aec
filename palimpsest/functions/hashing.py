"""Content identities and keyed digests from built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def framed(*fields: Column) -> Column:
    """Unambiguous text of several fields: code-point length, colon, value; NULL is `-`."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.concat(*parts)


def text_id(prefix: str, *fields: Column, size: int = 64) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(framed(*fields), 256), 1, size))


def content_hash(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def length_prefixed(*fields: Column) -> Column:
    """Binary fields, each preceded by its byte length as four big-endian bytes."""
    parts = []
    for field in fields:
        data = field.cast("binary")
        parts.append(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")))
        parts.append(data)
    return F.concat(*parts)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as binary. Only the two padded key blocks are prepared on the driver."""
    if len(key) > 64:
        raise ValueError("keys longer than one block are not supported")
    block = key.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in block).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in block).hex()))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))
