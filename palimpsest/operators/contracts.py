"""Payload contracts: closed, per-kind rules over JSON envelopes, reported as codes.

Booleans never count as integers: the variant schema tells `BIGINT` from `BOOLEAN`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The envelope's closed field set and the scoped kinds.
ENVELOPE_FIELDS = (
    "artifact_id", "artifact_kind", "content_hash", "created_at", "inputs", "payload",
    "producer", "schema_version", "scope_key",
)
SCHEMA_VERSION = "12.0.0"
SCOPED_KINDS = {
    "correction_transcript": "arm", "selection_batch": "batch_id", "selection_result": "batch_id",
}
# Field rules per kind. text: non-empty string; string: may be empty; positive
# and count: strict integers; list, object, bool; `a|b|c`: one of these strings.
_METADATA = (("provider_metadata.provider", "text"), ("provider_metadata.requested_model", "text"))
_ALIGNED = (
    ("run_id", "text"), ("transcript_artifact_id", "text"), ("media_object_artifact_id", "text"),
    ("timeline_audio_artifact_id", "text"),
)
_BLOB = (("content_hash", "text"), ("byte_length", "positive"), ("media_type", "text"))
PAYLOAD_RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "job_input": (("source_asset_id", "text"), ("references", "list"), ("user_keywords", "list")),
    "media_probe": (
        ("presentation_duration_ms", "positive"), ("presentation_total_samples", "positive"),
        ("timeline_status", "normal|corrected|unverified"),
    ),
    "timeline_audio": (
        ("source_asset_id", "text"), ("duration_ms", "positive"),
        ("total_sample_count", "positive"),
        *[(f"audio_blob.{n}", t) for n, t in _BLOB],
    ),
    "media_object": (
        ("timeline_audio_artifact_id", "text"), ("provider", "text"), ("bucket", "text"),
        ("object_key", "text"), ("content_hash", "text"), ("byte_length", "positive"),
    ),
    "base_asr": (("source_text", "text"), ("timed_units", "list"), *_METADATA),
    "peer_asr": (("source_text", "text"), ("timed_units", "list"), *_METADATA),
    "asr_comparison": (("hunks", "list"),),
    "correction_transcript": (("arm", "a|b"), ("corrected_text", "text"), *_METADATA),
    "merge_plan": (
        ("base_text", "text"), ("resolved_edits", "list"), ("review_items", "list"),
        ("variants", "object"),
    ),
    "selection_batch": (("batch_id", "text"), ("cases", "list"), ("prompt_sha256", "text")),
    "selection_result": (
        ("batch_id", "text"), ("decisions", "list"), ("request", "object"), *_METADATA,
    ),
    "edit_resolution": (
        ("base_text", "text"), ("resolved_edits", "list"), ("review_items", "list"),
        ("run_id", "text"), ("pending_selection", "count"), ("sealed", "bool"),
    ),
    "review_queue": (
        ("run_id", "text"), ("resolution_artifact_id", "text"), ("items", "list"),
        ("status", "clear|needs_review"),
    ),
    "review_resolution": (
        ("run_id", "text"), ("queue_artifact_id", "text"), ("decisions", "list"),
    ),
    "transcript": (
        ("source_text", "text"), ("base_asr_artifact_id", "text"),
        ("edit_resolution_artifact_id", "text"),
        ("correction_mode", "dual_fulltext_selection"),
    ),
    "ata_response": (
        *_ALIGNED, ("invocation_id", "text"), ("audio_text", "string"), *_METADATA,
        *[(f"response_blob.{n}", t) for n, t in _BLOB],
    ),
    "ata_result": (
        *_ALIGNED, ("ata_response_artifact_id", "text"), ("utterances", "list"),
        ("diagnostics.utterance_count", "count"),
        ("diagnostics.text_comparison.relation", "identical|differs"),
    ),
    "srt_render": (("run_id", "text"), ("ata_result_artifact_id", "text"), ("text", "string")),
}


def _holds(payload: Column, path: str, kind: str) -> Column:
    found = F.try_variant_get(payload, f"$.{path}", "variant")
    shape = F.schema_of_variant(found)
    if kind in ("text", "string"):
        test = shape == "STRING"
        if kind == "text":
            test = test & (F.try_variant_get(payload, f"$.{path}", "string") != "")
    elif kind in ("positive", "count"):
        low = 1 if kind == "positive" else 0
        test = (shape == "BIGINT") & (F.try_variant_get(payload, f"$.{path}", "bigint") >= low)
    elif kind == "list":
        test = shape.startswith("ARRAY")
    elif kind == "object":
        test = shape.startswith("OBJECT")
    elif kind == "bool":
        test = shape == "BOOLEAN"
    else:
        test = (shape == "STRING") & F.try_variant_get(payload, f"$.{path}", "string").isin(
            *kind.split("|")
        )
    return F.coalesce(test, F.lit(False))


def _payload_codes(payload: Column, kind: Column) -> Column:
    """Codes of the row's own kind only: the CASE evaluates one branch of rules."""
    empty = F.expr("cast(array() as array<string>)")
    codes = None
    for name, rules in PAYLOAD_RULES.items():
        failed = F.array_compact(
            F.array(*[F.when(~_holds(payload, p, t), F.lit(p)) for p, t in rules])
        )
        codes = F.when(kind == name, failed) if codes is None else codes.when(kind == name, failed)
    return codes.otherwise(empty)


def payload_contract(envelopes: DataFrame) -> DataFrame:
    """`doc_id, body` (JSON envelope) -> `doc_id, kind, codes`; no codes means accepted."""
    rows = envelopes.withColumn("v", F.try_parse_json("body"))
    kind = F.try_variant_get("v", "$.artifact_kind", "string")
    payload = F.try_variant_get("v", "$.payload", "variant")
    scope = F.try_variant_get("v", "$.scope_key", "string")
    names = F.array_sort(F.json_object_keys("body"))
    own = F.lit("global")
    for name, field in SCOPED_KINDS.items():
        own = F.when(
            kind == name, F.try_variant_get(payload, f"$.{field}", "string")
        ).otherwise(own)
    envelope = F.array_compact(
        F.array(
            F.when(F.col("v").isNull(), "malformed_json"),
            F.when(
                F.col("v").isNotNull() & ~names.eqNullSafe(F.array(*map(F.lit, ENVELOPE_FIELDS))),
                "envelope_fields",
            ),
            F.when(
                F.try_variant_get("v", "$.schema_version", "string") != SCHEMA_VERSION,
                "schema_version",
            ),
            F.when(kind.isNotNull() & ~kind.isin(*PAYLOAD_RULES), "unknown_kind"),
            F.when(kind.isin(*PAYLOAD_RULES) & ~scope.eqNullSafe(own), "scope_key"),
        )
    )
    codes = F.concat(envelope, _payload_codes(payload, kind))
    return rows.select("doc_id", kind.alias("kind"), F.array_join(codes, ",").alias("codes"))
