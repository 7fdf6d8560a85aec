"""Transcript variants derived from the documents table, in Spark and as oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.tables import table

# The word replacements that make each derived transcript.
VARIANTS = {
    "a": ((" the ", " THE "), (" of ", " OF "), (" is ", " IS ")),
    "b": ((" and ", " und "), (" of ", " off "), (" is ", " IS ")),
    "peer": ((" of ", " uv "),),
}


def with_variants(documents: DataFrame) -> DataFrame:
    base = F.col("text")
    columns = []
    for name, changes in VARIANTS.items():
        text = base
        for old, new in changes:
            text = F.replace(text, F.lit(old), F.lit(new))
        columns.append(text.alias(name))
    return documents.select("doc_id", base.alias("base"), *columns)


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return with_variants(table(spark, folder, "documents"))


def transcripts_sql() -> str:
    columns = []
    for name, changes in VARIANTS.items():
        text = "text"
        for old, new in changes:
            text = f"replace({text}, '{old}', '{new}')"
        columns.append(f"{text} AS {name}")
    return f"transcripts AS (SELECT doc_id, text AS base, {', '.join(columns)} FROM documents)"
