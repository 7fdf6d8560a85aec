"""Row-wise admission rules. Each keeps the row and says why it is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import content_hash
from palimpsest.functions.text import strip

# Admission limits and name patterns.
MAX_KEYWORDS = 100
MAX_DURATION_MS = 18_000_000
MAX_SOURCE_BYTES = 512_000_000
MAX_RAW_BYTES = 65_536
PHONE_PATTERN = r"\A\+[1-9][0-9]{1,14}\z"
DIGEST_PATTERN = r"\Ahmac-sha256:[A-Za-z0-9._-]{1,32}:[0-9a-f]{64}\z"
PROVIDERS = ("phone", "email", "wechat", "qq", "apple")
MAX_SUBJECT_BYTES = 512


def normalize_keywords(frame: DataFrame, column: str, limit: int = MAX_KEYWORDS) -> DataFrame:
    """Trim, drop exact repeats keeping the first, and say whether blanks or the limit refuse the list.

    `keywords` is the whole normalized list, whatever the outcome.
    """
    kept = F.array_distinct(F.transform(column, strip))
    outcome = (
        F.when(F.exists(kept, lambda k: k == ""), "blank")
        .when(F.size(kept) > limit, "too_many")
        .otherwise("ok")
    )
    return frame.withColumn("outcome", outcome).withColumn("keywords", kept)


def media_admission(frame: DataFrame) -> DataFrame:
    reason = F.when(F.col("bytes") >= MAX_SOURCE_BYTES, "too_large").when(
        F.col("duration_ms") >= MAX_DURATION_MS, "too_long"
    )
    return frame.withColumn("reason", F.coalesce(reason, F.lit("admitted")))


def is_strict_json(text: Column) -> Column:
    """False for malformed text, duplicate keys and non-finite numbers."""
    return F.try_parse_json(text).isNotNull()


def diagnostic_cap(frame: DataFrame, column: str) -> DataFrame:
    """Small bodies inline, larger ones in `overflow`, to be stored under `raw_sha256`: none is lost."""
    size = F.octet_length(column)
    return frame.select(
        *[c for c in frame.columns if c != column],
        F.when(size <= MAX_RAW_BYTES, F.col(column)).alias("raw_response"),
        F.when(size > MAX_RAW_BYTES, F.col(column)).alias("overflow"),
        content_hash(F.col(column)).alias("raw_sha256"),
        size.cast("long").alias("raw_byte_length"),
        (size > MAX_RAW_BYTES).alias("raw_truncated"),
    )


def is_phone(text: Column) -> Column:
    return text.rlike(PHONE_PATTERN)


def identity_claim_audit(frame: DataFrame) -> DataFrame:
    """Codes for unknown providers, malformed subjects and malformed token digests."""
    subject = F.col("subject")
    rules = (
        ("provider", ~F.col("provider").isin(*PROVIDERS)),
        (
            "subject",
            (subject == "")
            | (subject != strip(subject))
            | (F.octet_length(subject) > MAX_SUBJECT_BYTES),
        ),
        ("phone", (F.col("provider") == "phone") & ~is_phone(subject)),
        ("digest", ~F.col("digest").rlike(DIGEST_PATTERN)),
    )
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    return frame.withColumn("codes", F.array_join(codes, ","))
