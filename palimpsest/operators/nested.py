"""Payload contracts below the top level: rules of list items, closed field sets, order and rebuilt texts.

Each rule reads the JSON variant of its own row; nothing is shuffled. A list breaks a rule if one of its items
does, and the code names list and field (`timed_units.text`), so a row has each code once, in rule order.
A list that is missing or no list is the business of `contracts.payload_contract` and breaks nothing here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.contracts import _holds

# Fields of list items by kind. Field kinds as in `contracts.PAYLOAD_RULES`; integer may be negative,
# `?` stands before kinds that may be null or absent.
ITEM_RULES: dict[str, tuple[tuple[str, tuple[tuple[str, str], ...]], ...]] = {
    "job_input": (("references", (("display_name", "text"), ("kind", "pdf_object|image_object|text"))),),
    **{
        kind: (("timed_units", (("text", "text"), ("start_ms", "count"), ("end_ms", "positive"))),)
        for kind in ("base_asr", "peer_asr")
    },
    "asr_comparison": (
        ("hunks", (
            ("base_start", "count"), ("base_end", "count"), ("peer_start", "count"), ("peer_end", "count"),
            ("base_text", "string"), ("peer_text", "string"), ("category", "prosodic_format_only|lexical"),
        )),
    ),
    **{
        kind: (("resolved_edits", (("start", "count"), ("end", "count"), ("replacement", "string"))),)
        for kind in ("merge_plan", "edit_resolution")
    },
    "review_queue": (
        ("items", (("review_id", "text"), ("start", "count"), ("end", "count"), ("original", "string"))),
    ),
    "review_resolution": (("decisions", (("review_id", "text"), ("action", "keep|a|b|peer|replace"))),),
    "ata_result": (("utterances", (("text", "string"), ("start_ms", "integer"), ("end_ms", "integer"))),),
}
# Fields of nested objects by kind.
_METADATA = tuple(
    (f"provider_metadata.{name}", kind)
    for name, kind in (
        ("resolved_model", "?text"), ("response_id", "?text"), ("elapsed_ms", "?count"), ("reasoning_ms", "?count"),
    )
)
OBJECT_RULES: dict[str, tuple[tuple[str, str], ...]] = {
    **{k: _METADATA for k in ("base_asr", "peer_asr", "correction_transcript", "selection_result", "ata_response")},
    "ata_result": (
        *[
            (f"diagnostics.{name}", "count")
            for name in (
                "empty_text_count", "negative_time_count", "reversed_interval_count", "zero_duration_count",
                "overlap_count", "text_comparison.input_length", "text_comparison.output_length",
            )
        ],
        ("diagnostics.text_comparison.length_delta", "integer"),
    ),
}
PRODUCER_FIELDS = (
    ("component", "text"), ("component_version", "text"), ("provider", "?text"), ("model", "?text"),
    ("config_hash", "text"),
)
REFERENCE_OBJECT = (
    ("provider", "text"), ("bucket", "text"), ("object_key", "text"), ("content_hash", "text"), ("byte_length", "positive"),
)
REFERENCE_FORMATS = ("txt", "md", "csv", "json")
CANDIDATE_SOURCES = ("base", "a", "b", "peer")
MOST_KEYWORDS = 100


def _part(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _field(value: Column, path: str, kind: str) -> Column:
    if kind.startswith("?"):
        found = F.schema_of_variant(_part(value, path))
        return F.coalesce(found == "VOID", F.lit(True)) | _field(value, path, kind[1:])
    if kind == "integer":
        return F.coalesce(F.schema_of_variant(_part(value, path)) == "BIGINT", F.lit(False))
    return _holds(value, path, kind)


def _fails(path: str, kind: str):
    return lambda x: ~_field(x, path, kind)


def _keys(value: Column) -> Column:
    return F.array_sort(F.coalesce(F.json_object_keys(F.to_json(value)), F.expr("cast(array() as array<string>)")))


def _closed(value: Column, *fields: str) -> Column:
    return _keys(value) == F.array(*[F.lit(f) for f in sorted(fields)])


def _some(items: Column, bad) -> Column:
    """Is there an item for which `bad(item, place, list)` is not false?"""
    return F.exists(F.transform(items, lambda x, i: F.coalesce(bad(x, i), F.lit(True))), lambda b: b)


def _repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) != F.size(values)


def _references(items: Column):
    def objects(x: Column) -> Column:
        return _part(x, "kind", "string").isin("pdf_object", "image_object")

    def text(x: Column) -> Column:
        return _part(x, "kind", "string") == "text"

    yield "references.ordinal", _some(items, lambda x, i: ~(_holds(x, "ordinal", "count") & (_part(x, "ordinal", "bigint") == i)))
    for name, kind in REFERENCE_OBJECT:
        yield f"references.object.{name}", _some(
            items, lambda x, i, n=name, k=kind: F.coalesce(objects(x), F.lit(False)) & ~_field(x, f"object.{n}", k)
        )
    yield "references.url", F.exists(items, lambda x: objects(x) & _part(x, "url").isNotNull())
    for name, kind in (("format", "|".join(REFERENCE_FORMATS)), ("text", "text")):
        yield f"references.{name}", _some(
            items, lambda x, i, n=name, k=kind: F.coalesce(text(x), F.lit(False)) & ~_field(x, n, k)
        )


def _keywords(payload: Column):
    words = _part(payload, "user_keywords", "array<variant>")
    yield "user_keywords.text", _some(words, lambda x, i: (F.schema_of_variant(x) != "STRING") | (x.cast("string") == ""))
    texts = F.transform(words, lambda x: F.to_json(x))
    yield "user_keywords.set", (F.size(texts) > MOST_KEYWORDS) | _repeats(texts)


def _units(items: Column):
    spans = F.transform(
        items, lambda x: F.struct(_part(x, "start_ms", "bigint").alias("s"), _part(x, "end_ms", "bigint").alias("e"))
    )
    yield "timed_units.interval", F.exists(spans, lambda x: x["e"] <= x["s"])
    late = F.zip_with(F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), spans, lambda x, y: x["s"] < y["e"])
    yield "timed_units.order", F.exists(late, lambda b: b)


def _edits(payload: Column):
    base = _part(payload, "base_text", "string")
    plain = F.array_sort(F.transform(
        _part(payload, "resolved_edits", "array<variant>"),
        lambda x: F.struct(
            *[_part(x, n, "bigint").alias(n) for n in ("start", "end")],
            *[_part(x, n, "string").alias(n) for n in ("original", "replacement")],
        ),
    ))

    def rebuilt(bound: Column) -> Column:
        base, edits = bound["base"], bound["edits"]

        def before(i: Column, name: str) -> Column:
            return F.when(i > 0, F.get(edits, i - 1)[name])

        fault = _some(edits, lambda e, i: ~(
            (e["start"] >= 0) & (e["start"] <= e["end"]) & (e["end"] <= F.length(base))
            & (e["start"] >= F.coalesce(before(i, "end"), F.lit(0)))
            & (e["start"] > F.coalesce(before(i, "start"), F.lit(-1)))
        ))
        stale = _some(edits, lambda e, i: F.substring(base, e["start"] + 1, e["end"] - e["start"]) != e["original"])
        pieces = F.transform(edits, lambda e, i: F.concat(
            F.substring(base, F.coalesce(before(i, "end"), F.lit(0)) + 1, e["start"] - F.coalesce(before(i, "end"), F.lit(0))),
            e["replacement"],
        ))
        last = F.coalesce(F.get(edits, F.size(edits) - 1)["end"], F.lit(0))
        text = F.concat(F.array_join(pieces, ""), F.substring(base, last + 1, F.length(base)))
        return F.struct(fault.alias("fault"), stale.alias("stale"), text.alias("text"))

    found = F.transform(F.array(F.struct(base.alias("base"), plain.alias("edits"))), rebuilt)[0]
    yield "resolved_edits.interval", found["fault"]
    yield "resolved_edits.original", ~found["fault"] & found["stale"]
    yield "corrected_preview", ~found["fault"] & ~found["stale"] & ~F.coalesce(
        _part(payload, "corrected_preview", "string") == found["text"], F.lit(False)
    )


def _sealed(payload: Column):
    waits = (_part(payload, "pending_selection", "bigint") > 0) | (F.size(_part(payload, "review_items", "array<variant>")) > 0)
    yield "sealed", (_part(payload, "sealed", "string") == "true") & waits


def _variants(payload: Column):
    texts = _part(payload, "variants")
    yield "variants.fields", ~_closed(texts, *CANDIDATE_SOURCES)
    for name in CANDIDATE_SOURCES:
        yield f"variants.{name}", ~_field(texts, name, "string")


def _queue(payload: Column):
    items = _part(payload, "items", "array<variant>")
    yield "items.repeated", _repeats(F.transform(items, lambda x: _part(x, "review_id", "string")))
    yield "items.interval", F.exists(items, lambda x: _part(x, "end", "bigint") < _part(x, "start", "bigint"))
    yield "items.length", _some(
        items, lambda x, i: F.length(_part(x, "original", "string")) != _part(x, "end", "bigint") - _part(x, "start", "bigint")
    )
    yield "items.sources", _some(items, lambda x, i: F.size(F.array_except(
        _keys(_part(x, "candidates")), F.array(*map(F.lit, CANDIDATE_SOURCES))
    )) > 0)
    yield "items.base", _some(items, lambda x, i: _part(x, "candidates.base", "string") != _part(x, "original", "string"))
    yield "status", (_part(payload, "status", "string") == "clear") != (F.size(items) == 0)


def _reviews(items: Column):
    def closed(x: Column, i: Column) -> Column:
        fields = _closed(x, "review_id", "action")
        return ~F.when(_part(x, "action", "string") == "replace", _closed(x, "review_id", "action", "replacement")).otherwise(fields)

    yield "decisions.fields", _some(items, closed)
    yield "decisions.repeated", _repeats(F.transform(items, lambda x: _part(x, "review_id", "string")))
    yield "decisions.replacement", F.exists(
        items, lambda x: (_part(x, "action", "string") == "replace") & ~_field(x, "replacement", "string")
    )


def _decisions(payload: Column):
    items = _part(payload, "decisions", "array<variant>")
    cases = _part(payload, "request.cases", "array<variant>")
    pairs = F.flatten(F.transform(cases, lambda c: F.transform(
        _part(c, "candidates", "array<variant>"),
        lambda v: F.struct(_part(c, "case_id", "string").alias("c"), _part(v, "candidate_id", "string").alias("v")),
    )))
    given = F.transform(items, lambda x: F.struct(_part(x, "case_id", "string").alias("c"), _part(x, "candidate_id", "string").alias("v")))
    yield "decisions.fields", _some(items, lambda x, i: ~_closed(x, "case_id", "candidate_id"))
    yield "decisions.unknown", F.size(F.array_except(given, pairs)) > 0
    chosen = F.transform(items, lambda x: _part(x, "case_id", "string"))
    yield "decisions.repeated", _repeats(chosen)
    yield "decisions.missing", F.size(F.array_except(F.transform(cases, lambda c: _part(c, "case_id", "string")), chosen)) > 0


def _own_rules(kind: str, payload: Column):
    """(code, fault) of all rules of a kind, in order."""
    for name, fields in ITEM_RULES.get(kind, ()):
        items = _part(payload, name, "array<variant>")
        for field, shape in fields:
            yield f"{name}.{field}", F.exists(items, _fails(field, shape))
    for path, shape in OBJECT_RULES.get(kind, ()):
        yield path, ~_field(payload, path, shape)
    if kind == "job_input":
        yield from _references(_part(payload, "references", "array<variant>"))
        yield from _keywords(payload)
    elif kind in ("base_asr", "peer_asr"):
        yield from _units(_part(payload, "timed_units", "array<variant>"))
    elif kind in ("merge_plan", "edit_resolution"):
        yield from _edits(payload)
        yield from (_sealed if kind == "edit_resolution" else _variants)(payload)
    elif kind == "review_queue":
        yield from _queue(payload)
    elif kind == "review_resolution":
        yield from _reviews(_part(payload, "decisions", "array<variant>"))
    elif kind == "selection_result":
        yield from _decisions(payload)
    elif kind == "media_object":
        yield "get_url", _part(payload, "get_url").isNotNull()


NESTED_KINDS = tuple(dict.fromkeys([*ITEM_RULES, *OBJECT_RULES, "media_object"]))


def _envelope(v: Column):
    yield "producer.fields", ~_closed(_part(v, "producer"), *[n for n, _ in PRODUCER_FIELDS])
    for name, shape in PRODUCER_FIELDS:
        yield f"producer.{name}", ~_field(_part(v, "producer"), name, shape)
    inputs = _part(v, "inputs", "array<variant>")
    yield "inputs.role", F.exists(inputs, lambda x: ~_field(x, "role", "text"))
    yield "inputs.one_id", F.exists(inputs, lambda x: _part(x, "artifact_id", "string").isNull() == _part(x, "source_asset_id", "string").isNull())


def nested_contract(envelopes: DataFrame) -> DataFrame:
    """`doc_id, body` (JSON envelope) -> `doc_id, kind, codes`; null or malformed bodies have kind null, no codes."""
    rows = envelopes.select("doc_id", F.try_parse_json("body").alias("v"))
    rows = rows.select(
        "doc_id", "v", _part(F.col("v"), "artifact_kind", "string").alias("kind"), _part(F.col("v"), "payload").alias("payload")
    )

    def listed(rules) -> Column:
        return F.array_compact(F.array(*[F.when(fault, F.lit(code)) for code, fault in rules]))

    own = None
    for name in NESTED_KINDS:
        codes = listed(_own_rules(name, F.col("payload")))
        own = F.when(F.col("kind") == name, codes) if own is None else own.when(F.col("kind") == name, codes)
    own = own.otherwise(F.expr("cast(array() as array<string>)"))
    whole = F.when(F.col("v").isNotNull(), F.concat(listed(_envelope(F.col("v"))), own))
    codes = F.coalesce(F.array_join(whole, ","), F.lit(""))
    return rows.select("doc_id", "kind", codes.alias("codes"))
