"""Registered queries against their oracles on the small tables."""

import duckdb
import pytest

from palimpsest.plans import catalog

FOLDER = "/root/testdata/sf0.001"
CHEAP = [
    "media_admission", "strict_json", "content_id", "current_pointer", "dangling_refs",
    "retry_chain", "crash_recovery", "artifact_upsert", "checkpoint_upsert", "latency_quantiles", "active_sessions",
    "session_eviction", "challenge_replay", "reputation_audit", "ban_overturn",
    "operation_dedupe", "key_rotation_lookup", "encrypt_column", "payload_contract", "nested_contract", "content_store",
    "progress_stream", "rate_limit_stream", "batch_infer", "transcripts_utterance_json",
]


def plain(value):
    if hasattr(value, "asDict"):
        return str(value.asDict())
    return float(value) if type(value).__name__ == "Decimal" else value


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert len(catalog.QUERIES) == 104


@pytest.mark.parametrize("key", CHEAP)
def test_query_equals_oracle(spark, key):
    database = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    frame = catalog.QUERIES[key](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    cursor = database.execute(catalog.ORACLES[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = [[plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()]
    assert got == sorted(map(repr, wanted))
