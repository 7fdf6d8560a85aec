"""Nested payload rules: one change, its codes; bodies that are no envelopes; long lists."""

import json
import random

import pytest

from palimpsest.operators.nested import NESTED_KINDS, nested_contract
from palimpsest.plans.queries_contracts import _BODIES, _CHANGES, _WHOLE


def envelope(kind, payload, **more):
    producer = {"component": "c", "component_version": "1", "provider": None, "model": None, "config_hash": "h"}
    return json.dumps({"artifact_kind": kind, "payload": payload, "producer": producer, "inputs": [], **more})


def codes(spark, bodies):
    frame = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")
    return [r.codes for r in nested_contract(frame).orderBy("doc_id").collect()]


def test_whole_payloads_break_nothing_and_every_change_breaks_the_rule_at_its_place(spark):
    bodies = [b.replace("@LEN@", "4").replace("@MORE@", "7").replace("@TEXT@", "a\\nbc") for b in _BODIES]
    got = codes(spark, bodies)
    assert got[:len(_WHOLE)] == [""] * len(_WHOLE)
    for (kind, path, _), found in zip(_CHANGES, got[len(_WHOLE):], strict=False):
        lists = path.lstrip("^").split(".")[0]
        assert found.split(",")[0].split(".")[0] in (lists, "sealed", "status"), (kind, path, found)


def test_bodies_that_are_no_envelopes(spark):
    bodies = [None, "", "[1]", "{}", envelope("base_asr", None), envelope("unknown", {}), envelope("review_queue", {"items": {}})]
    got = codes(spark, bodies)
    assert got[:2] == ["", ""]
    assert got[3].startswith("producer.fields,producer.component")
    assert got[4] == ""
    assert (got[5], got[6]) == ("", "")
    assert codes(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_edits_rebuild_like_one_by_one(spark, seed):
    rng = random.Random(seed)
    bodies, wanted = [], []
    for _ in range(60):
        base = "".join(rng.choice("ab\U0001f600 ") for _ in range(12))
        edits = []
        for _ in range(rng.randint(0, 3)):
            start = rng.randint(0, 12)
            end = min(12, start + rng.randint(0, 3))
            edits.append({"start": start, "end": end, "original": base[start:end], "replacement": rng.choice(["", "x", "yy"])})
        text, limit, fault = base, 13, False
        for edit in sorted(edits, key=lambda e: e["start"], reverse=True):
            fault |= edit["end"] > limit or edit["start"] == limit
            limit = edit["start"]
            text = text[:limit] + edit["replacement"] + text[edit["end"]:]
        wrong = rng.random() < 0.3
        bodies.append(envelope("edit_resolution", {
            "base_text": base, "resolved_edits": edits, "review_items": [], "pending_selection": 0, "sealed": True,
            "corrected_preview": text + "!" * wrong,
        }))
        wanted.append("resolved_edits.interval" if fault else "corrected_preview" if wrong else "")
    assert codes(spark, bodies) == wanted
    assert len(set(wanted)) == 3


def test_long_lists_are_checked_to_their_last_item(spark):
    units = [{"text": "t", "start_ms": i, "end_ms": i + 1} for i in range(20_000)]
    late = [*units[:-1], {"text": "t", "start_ms": 19_998, "end_ms": 20_000}]
    meta = {"provider": "p", "requested_model": "m"}
    got = codes(spark, [envelope("peer_asr", {"timed_units": u, "provider_metadata": meta}) for u in (units, late)])
    assert got == ["", "timed_units.order"]
    assert "peer_asr" in NESTED_KINDS
