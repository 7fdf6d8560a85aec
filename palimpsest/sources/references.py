"""Reference files: reading, kinds, and a structural PDF check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.hashing import content_hash

# Accepted file formats.
TEXT_FORMATS = ("txt", "md", "csv", "json")
OFFICE_FORMATS = ("doc", "docx", "ppt", "pptx", "xls", "xlsx")
IMAGE_FORMATS = ("png", "jpg", "jpeg", "webp")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder as `name, content`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _bytes(text: str) -> Column:
    return F.encode(F.lit(text), "UTF-8")


def is_usable_pdf(content: Column) -> Column:
    """A header near the start, an end mark near the end, and no encryption entry there."""
    head = F.substring(content, 1, 1024)
    size = F.octet_length(content)
    tail = F.substring(content, F.greatest(size - 2047, F.lit(1)), F.lit(2048))
    return (
        F.contains(head, _bytes("%PDF-"))
        & F.contains(tail, _bytes("%%EOF"))
        & ~F.contains(tail, _bytes("/Encrypt"))
    )


def ingest(files: DataFrame) -> DataFrame:
    """Kind, identity and availability of each file; a failure is a reason, never an error."""
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)\z", 1))
    content = F.col("content")
    body = F.try_validate_utf8(content)
    text = F.regexp_replace(body, "\\A\ufeff", "")
    kind = (
        F.when(suffix.isin(*TEXT_FORMATS), "text")
        .when(suffix == "pdf", "pdf_object")
        .when(suffix.isin(*OFFICE_FORMATS), "office")
        .when(suffix.isin(*IMAGE_FORMATS), "image_object")
        .otherwise("unsupported")
    )
    reason = (
        F.when(F.octet_length(content) == 0, "empty_source")
        .when(kind == "unsupported", "unsupported_format")
        .when((kind == "text") & body.isNull(), "invalid_utf8")
        .when((kind == "text") & (text == ""), "empty_text")
        .when((kind == "pdf_object") & ~is_usable_pdf(content), "damaged_pdf")
        .when(kind == "office", "needs_conversion")
        .otherwise("available")
    )
    return files.select(
        *[c for c in files.columns if c != "content"],
        kind.alias("kind"),
        reason.alias("reason"),
        content_hash(content).alias("content_hash"),
        F.octet_length(content).cast("long").alias("byte_length"),
        F.when(reason == "available", F.when(kind == "text", text)).alias("text"),
    )
