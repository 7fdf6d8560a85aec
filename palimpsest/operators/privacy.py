"""Pseudonyms, encrypted columns and redaction from built-in expressions."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import hmac_sha256, length_prefixed

# How much of a message an excerpt shows, and which names carry credentials.
MAX_MESSAGE = 4096
NAMES = (
    r"x-api-(?:app-|access-)?key|authorization|(?:[\p{L}\p{N}_]+_)?api_key|"
    r"tos_(?:access|secret)_key|x-tos-(?:credential|signature|security-token)|"
    r"ossaccesskeyid|signature"
)
# A value is quoted (a backslash hides the next character), follows an authorization scheme, or is bare.
QUOTED = "|".join(rf"{q}(?:[^\\{q}]|\\[\s\S])*{q}" for q in ('"', "'"))
BARE = r"[^\s\"'&,;}\]]+"
SCHEME = rf"(?:basic|bearer;?)\s+{BARE}"
DONE = r"\[REDACTED\]"
VALUES = rf"(?:{QUOTED}|{SCHEME}|{DONE}|{BARE})"
CREDENTIAL = rf"(?iu)(?<![\p{{L}}\p{{N}}_-])((?:{NAMES})[\"']?\s*[:=]\s*){VALUES}"


def redact(frame: DataFrame, column: str, secrets: list[str]) -> DataFrame:
    """Replace known secrets (longest first, also URL- and JSON-escaped), then named values.

    `body` is the whole cleaned text; `excerpt` its first `MAX_MESSAGE` characters. Redaction comes before the
    cut, so that no secret survives at it.
    """
    forms = {f for s in secrets for f in (s, quote(s, safe=""), json.dumps(s)[1:-1])}
    text = F.col(column)
    for form in sorted(forms, key=lambda f: (-len(f), f)):
        text = F.replace(text, F.lit(form), F.lit("[REDACTED]"))
    text = F.regexp_replace(text, CREDENTIAL, "$1[REDACTED]")
    return frame.withColumn("_clean", text).select(
        *[c for c in frame.columns if c != column],
        F.col("_clean").alias("body"),
        F.substring("_clean", 1, MAX_MESSAGE).alias("excerpt"),
        (F.length("_clean") > MAX_MESSAGE).alias("excerpt_cut"),
    )


def lookup_key(key: bytes, purpose: str, value: Column) -> Column:
    """Keyed digest of a value under a purpose; both are length-prefixed."""
    return hmac_sha256(key, length_prefixed(F.lit(purpose), value))


def find_by_any_key(
    phones: DataFrame, stored: DataFrame, keys: dict[str, bytes], purpose: str
) -> DataFrame:
    """Look phones up under every known key; a phone stored under two keys is an error."""
    asked = phones.select(
        "phone",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(key_id).alias("key_id"),
                        lookup_key(key, purpose, F.col("phone")).alias("digest"),
                    )
                    for key_id, key in sorted(keys.items())
                ]
            )
        ).alias("k"),
    ).select("phone", "k.key_id", "k.digest")
    hits = asked.join(stored.select("key_id", "digest", "reputation_id"), ["key_id", "digest"], "left")
    found = hits.groupBy("phone").agg(
        F.count("reputation_id").alias("matches"), F.min("reputation_id").alias("reputation_id")
    )
    outcome = (
        F.when(F.col("matches") == 0, "absent")
        .when(F.col("matches") == 1, "found")
        .otherwise("duplicate")
    )
    return found.select("phone", "matches", "reputation_id", outcome.alias("outcome"))


def unknown_keys(stored: DataFrame, known: list[str]) -> DataFrame:
    return (
        stored.where(~F.col("key_id").isin(*known))
        .groupBy("key_id")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def encrypt_column(
    frame: DataFrame, value: str, row_id: str, key: bytes, *, iv: Column | None = None
) -> DataFrame:
    """AES-256-GCM with the row id as associated data; the IV is random unless given."""
    aad = F.concat(F.lit("reputation:v1:"), F.col(row_id).cast("string"))
    secret = F.unhex(F.lit(key.hex()))
    plain = F.col(value).cast("binary")
    cipher = F.aes_encrypt(
        plain, secret, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit("")) if iv is None else iv, aad
    )
    return frame.withColumn("cipher", cipher)


def decrypt_audit(
    frame: DataFrame, row_id: str, key: bytes, lookup: bytes, purpose: str
) -> DataFrame:
    """Can each `cipher` be read in its own row, and does it match its lookup digest?"""
    aad = F.concat(F.lit("reputation:v1:"), F.col(row_id).cast("string"))
    secret = F.unhex(F.lit(key.hex()))
    opened = F.try_aes_decrypt("cipher", secret, F.lit("GCM"), F.lit("DEFAULT"), aad)
    plain = opened.cast("string")
    outcome = (
        F.when(plain.isNull(), "unreadable")
        .when(lookup_key(lookup, purpose, plain) != F.col("digest"), "key_mismatch")
        .otherwise("ok")
    )
    return frame.select(row_id, outcome.alias("outcome"))


def blocklist_filter(frame: DataFrame, column: str, blocklist: DataFrame) -> DataFrame:
    """Rows whose folded value is not listed. Spark's `lower` is the folding used here."""
    listed = blocklist.select(F.lower("value").alias("_folded")).distinct()
    return frame.withColumn("_folded", F.lower(column)).join(
        listed, "_folded", "left_anti"
    ).drop("_folded")

