"""All registered queries and their oracle SQL."""

from __future__ import annotations

from palimpsest.plans import queries_accounts, queries_contracts, queries_ledger, queries_media_text, queries_runs, queries_selection, queries_streams, queries_text

QUERIES = {}
ORACLES = {}
for module in (queries_text, queries_selection, queries_media_text, queries_runs, queries_accounts, queries_ledger, queries_streams, queries_contracts):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
