"""Timed units from the three provider result documents; bad documents are quarantined whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _typed(value: Column, path: str, *types: str) -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.schema_of_variant(found).isin(*types), F.lit(False))


def _timed(
    documents: DataFrame,
    *,
    text_path: str | None,
    units_path: str,
    start_paths: tuple[str, ...],
    judged: bool,
    confidence: bool,
) -> DataFrame:
    """`doc_id, body` -> `doc_id, reason, doc_text, units`; `reason` NULL means usable."""
    value = F.try_parse_json("body")
    units = F.try_variant_get(value, units_path, "array<variant>")

    def unit(u: Column) -> Column:
        starts = [
            F.when(
                F.try_variant_get(u, p, "variant").isNotNull(), F.struct(
                    F.when(_typed(u, p, "BIGINT"), F.try_variant_get(u, p, "bigint")).alias("v")
                )
            )
            for p in start_paths
        ]
        fields = [
            F.when(_typed(u, "$.text", "STRING"), F.try_variant_get(u, "$.text", "string")).alias(
                "text"
            ),
            F.coalesce(*starts)["v"].alias("start_ms"),
            F.when(
                _typed(u, "$.end_time", "BIGINT"), F.try_variant_get(u, "$.end_time", "bigint")
            ).alias("end_ms"),
        ]
        if confidence:
            number = F.schema_of_variant(F.try_variant_get(u, "$.confidence", "variant"))
            fields.append(
                F.when(
                    number.isin("BIGINT", "DOUBLE") | number.startswith("DECIMAL"),
                    F.try_variant_get(u, "$.confidence", "double"),
                ).alias("confidence")
            )
        return F.struct(*fields)

    def sound(u: Column) -> Column:
        known = u["text"].isNotNull() & u["start_ms"].isNotNull() & u["end_ms"].isNotNull()
        if not judged:
            return known
        return F.coalesce(
            known & (u["text"] != "") & (u["start_ms"] >= 0) & (u["end_ms"] > u["start_ms"]),
            F.lit(False),
        )

    parsed = documents.withColumn("v", value).withColumn("units", F.transform(units, unit))
    checks = [(F.col("v").isNull(), "malformed_json")]
    text = F.lit(None).cast("string")
    if text_path is not None:
        text = F.when(
            _typed(F.col("v"), text_path, "STRING"),
            F.try_variant_get(F.col("v"), text_path, "string"),
        )
        checks.append((F.coalesce(text == "", F.lit(True)), "missing_text"))
    checks.append((F.col("units").isNull(), "missing_units"))
    if judged:
        checks.append((F.size("units") == 0, "missing_units"))
    checks.append((~F.forall("units", sound), "bad_unit"))
    reason = F.lit(None).cast("string")
    for test, code in reversed(checks):
        reason = F.when(test, code).otherwise(reason)
    return parsed.select("doc_id", reason.alias("reason"), text.alias("doc_text"), "units")


def sentence_documents(documents: DataFrame) -> DataFrame:
    """First transcript's text and `sentences`; `begin_time` wins over `start_time`."""
    return _timed(
        documents,
        text_path="$.transcripts[0].text",
        units_path="$.transcripts[0].sentences",
        start_paths=("$.begin_time", "$.start_time"),
        judged=True,
        confidence=False,
    )


def utterance_documents(documents: DataFrame) -> DataFrame:
    """`result.text` and `result.utterances`, with an optional numeric confidence."""
    return _timed(
        documents,
        text_path="$.result.text",
        units_path="$.result.utterances",
        start_paths=("$.start_time",),
        judged=True,
        confidence=True,
    )


def alignment_documents(documents: DataFrame) -> DataFrame:
    """Top-level `utterances`: empty text is legal and times are read but not judged."""
    return _timed(
        documents,
        text_path=None,
        units_path="$.utterances",
        start_paths=("$.start_time",),
        judged=False,
        confidence=False,
    )


def unit_rows(parsed: DataFrame) -> DataFrame:
    """One row per unit of usable documents, one row with a reason for the others."""
    good = parsed.where(F.col("reason").isNull()).select(
        "doc_id", "reason", F.posexplode("units").alias("pos", "u")
    )
    fields = [f for f in parsed.schema["units"].dataType.elementType.fieldNames()]
    good = good.select("doc_id", "reason", "pos", *[F.col(f"u.{f}").alias(f) for f in fields])
    bad = parsed.where(F.col("reason").isNotNull()).select("doc_id", "reason")
    return good.unionByName(bad, allowMissingColumns=True)
