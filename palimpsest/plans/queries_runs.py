"""Registered lineage, run history and accounting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.hashing import content_hash, framed
from palimpsest.operators import lineage as L
from palimpsest.operators.review import plan_audit
from palimpsest.plans.oracle_text import framed_sql
from palimpsest.plans.recipes import recipe, recipe_sql
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import table

registry = Registry()
query = registry.query

_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in L.STAGE_EDGES)
CLOSURE_SQL = f"""stage_edges(root, stage) AS (VALUES {_EDGES}),
closure AS (SELECT root, stage FROM stage_edges
  UNION SELECT c.root, e.stage FROM closure c JOIN stage_edges e ON e.root = c.stage),
op_stages(operation, stage) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in L.OPERATION_STAGES)})"""
LATEST_SQL = """latest AS (SELECT * FROM invocations QUALIFY row_number() OVER (
  PARTITION BY run_id, round, logical_key ORDER BY created_at DESC, invocation_id DESC) = 1)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_ID_FIELDS = (
    "'transcript'", "'global'", "'12.0'", framed_sql("'importer'", "lang"),
    framed_sql("source"), framed_sql("text", "n_chars"),
)
_HASH_SQL = f"'sha256:' || sha256({framed_sql(*_ID_FIELDS)})"


def _content_hash():
    return L.content_identity(
        F.lit("transcript"),
        F.lit("global"),
        F.concat(F.lit("12.0."), (F.col("doc_id") % 3).cast("string")),
        [F.lit("importer"), F.col("lang")],
        [F.col("source")],
        [F.col("text"), F.col("n_chars")],
    )


@query(
    "content_id",
    f"SELECT doc_id, {_HASH_SQL} AS content_hash, 'art_' || substr({_HASH_SQL}, 8) "
    "AS artifact_id FROM documents",
)
def content_id(spark: SparkSession, folder: str) -> DataFrame:
    hashed = table(spark, folder, "documents").select("doc_id", _content_hash().alias("content_hash"))
    return hashed.withColumn(
        "artifact_id", F.concat(F.lit("art_"), F.substring("content_hash", 8, 64))
    )


@query(
    "id_audit",
    """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 17 = 0 THEN 'hash' END,
  CASE WHEN doc_id % 19 = 0 THEN 'length' END) AS codes FROM documents
WHERE doc_id % 17 = 0 OR doc_id % 19 = 0""",
)
def id_audit(spark: SparkSession, folder: str) -> DataFrame:
    good = content_hash(F.col("text"))
    size = F.octet_length("text")
    stored = table(spark, folder, "documents").select(
        "doc_id",
        "text",
        F.when(F.col("doc_id") % 17 == 0, F.concat(good, F.lit("0"))).otherwise(good).alias("h"),
        F.when(F.col("doc_id") % 19 == 0, size + 1).otherwise(size).alias("n"),
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("h") != good, "hash"), F.when(F.col("n") != size, "length")
        )
    )
    return stored.select("doc_id", F.array_join(codes, ",").alias("codes")).where(
        F.col("codes") != ""
    )


@query(
    "artifact_upsert",
    with_(
        recipe_sql("artifacts"),
        """n AS (SELECT run_id, artifact_id, kind,
    CASE WHEN created_at % 50 = 0 THEN content_hash || 'x' ELSE content_hash END AS h
  FROM artifacts WHERE place >= 2
  UNION ALL SELECT run_id, artifact_id + 50, kind, content_hash FROM artifacts WHERE place = 1
  UNION ALL SELECT run_id, artifact_id + 70, kind, content_hash FROM artifacts WHERE place >= 3),
o AS (SELECT * FROM artifacts WHERE place <= 3)""",
        """judged AS (SELECT n.*, CASE WHEN o.content_hash = n.h THEN 'unchanged'
  WHEN o.artifact_id IS NOT NULL THEN 'collision'
  WHEN EXISTS (SELECT 1 FROM o d WHERE d.run_id = n.run_id AND d.kind = n.kind
    AND d.content_hash = n.h) THEN 'duplicate_content' ELSE 'inserted' END AS outcome
FROM n LEFT JOIN o ON o.run_id = n.run_id AND o.artifact_id = n.artifact_id)""",
    )
    + """SELECT run_id, artifact_id, CASE WHEN outcome = 'inserted' AND EXISTS (SELECT 1 FROM judged e
  WHERE e.outcome = 'inserted' AND e.run_id = j.run_id AND e.kind = j.kind AND e.h = j.h
    AND e.artifact_id < j.artifact_id) THEN 'duplicate_content' ELSE outcome END AS outcome FROM judged j""",
)
def artifact_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = recipe(spark, folder, "artifacts")
    changed = F.when(
        F.col("created_at") % 50 == 0, F.concat("content_hash", F.lit("x"))
    ).otherwise(F.col("content_hash"))
    place, own = F.col("place"), F.col("artifact_id")
    sides = [
        (place <= 3, own, F.col("content_hash"), True), (place >= 2, own, changed, False),
        (place == 1, own + 50, F.col("content_hash"), False), (place >= 3, own + 70, F.col("content_hash"), False),
    ]
    each = F.array(*[
        F.struct(taken.alias("taken"), i.alias("artifact_id"), h.alias("content_hash"), F.lit(stored).alias("stored"))
        for taken, i, h, stored in sides
    ])
    return L.upsert_outcomes(rows.select("run_id", "kind", F.inline(each)).where("taken"))


@query(
    "config_drift",
    "SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 = 0",
)
def config_drift(spark: SparkSession, folder: str) -> DataFrame:
    current = content_hash(framed(F.lit("merge-v2"), F.lit("model-3"), F.lit("prompt-7")))
    older = content_hash(framed(F.lit("merge-v2"), F.lit("model-2"), F.lit("prompt-7")))
    runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 10 == 0, older).otherwise(current).alias("config_hash"),
    )
    return runs.where(F.col("config_hash") != current).select("run_id", "status")


@query(
    "current_pointer",
    with_(recipe_sql("marks"))
    + """SELECT c.run_id, c.kind, c.scope, c.artifact_id, EXISTS (SELECT 1 FROM marks s
  WHERE NOT s.activates AND s.run_id = c.run_id AND s.kind = c.kind
    AND (s.scope IS NULL OR s.scope = c.scope) AND s.seq > c.seq) AS is_stale
FROM (SELECT * FROM marks WHERE activates QUALIFY row_number() OVER (
  PARTITION BY run_id, kind, scope ORDER BY seq DESC) = 1) c""",
)
def current_pointer(spark: SparkSession, folder: str) -> DataFrame:
    marks = recipe(spark, folder, "marks")
    return L.current_pointers(marks.where("activates"), marks.where("not activates"))


@query(
    "lineage_dependents",
    with_(recipe_sql("inputs"))
    + """SELECT a.run_id, i.input_artifact_id, a.artifact_id, a.created_at FROM artifacts a
JOIN inputs i ON i.run_id = a.run_id AND i.artifact_id = a.artifact_id
WHERE a.kind = 'kind_1' AND i.input_artifact_id IS NOT NULL""",
)
def lineage_dependents(spark: SparkSession, folder: str) -> DataFrame:
    return L.dependents(
        recipe(spark, folder, "artifacts"), recipe(spark, folder, "inputs"), "kind_1"
    )


@query(
    "dangling_refs",
    with_(recipe_sql("inputs"))
    + """SELECT i.run_id, i.artifact_id, i.ordinal, 'absent_artifact' AS code FROM inputs i
LEFT JOIN artifacts a ON a.run_id = i.run_id AND a.artifact_id = i.input_artifact_id
WHERE i.input_artifact_id IS NOT NULL AND a.artifact_id IS NULL
UNION ALL SELECT run_id, artifact_id, ordinal, 'not_exactly_one_source' FROM inputs
WHERE (input_artifact_id IS NULL) = (input_source_id IS NULL)""",
)
def dangling_refs(spark: SparkSession, folder: str) -> DataFrame:
    return L.dangling_references(
        recipe(spark, folder, "artifacts"), recipe(spark, folder, "inputs")
    )


@query(
    "dag_descendants",
    with_(recipe_sql("invocations"), CLOSURE_SQL)
    + """SELECT DISTINCT i.run_id, c.stage FROM invocations i
JOIN op_stages o ON o.operation = i.operation JOIN closure c ON c.root = o.stage
WHERE i.status <> 'succeeded'""",
)
def dag_descendants(spark: SparkSession, folder: str) -> DataFrame:
    failed = recipe(spark, folder, "invocations").where(F.col("status") != "succeeded")
    roots = failed.join(F.broadcast(L.operation_stages(spark)), "operation").select(
        "run_id", "stage"
    )
    return L.downstream_stages(roots, L.stage_closure(spark))


@query(
    "invalidate",
    with_(
        recipe_sql("checkpoints", "pointers", "roots"),
        CLOSURE_SQL,
        "touched AS (SELECT run_id, stage FROM roots UNION "
        "SELECT r.run_id, c.stage FROM roots r JOIN closure c ON c.root = r.stage)",
    )
    + """SELECT k.run_id, k.stage, k.scope, k.artifact_id, 'drop_checkpoint' AS action
FROM checkpoints k JOIN touched t ON t.run_id = k.run_id AND t.stage = k.stage
WHERE k.round IN (0, 2)
UNION ALL SELECT p.run_id, p.stage, p.scope, p.artifact_id, 'mark_stale'
FROM pointers p JOIN touched t ON t.run_id = p.run_id AND t.stage = p.stage""",
)
def invalidate(spark: SparkSession, folder: str) -> DataFrame:
    rounds = recipe(spark, folder, "runs").select("run_id", F.lit(2).alias("current_round"))
    return L.invalidate(
        recipe(spark, folder, "roots"),
        L.stage_closure(spark),
        recipe(spark, folder, "checkpoints"),
        rounds,
        recipe(spark, folder, "pointers"),
    )


@query(
    "retry_carryover",
    with_(
        recipe_sql("checkpoints", "invocations", "runs", "preparations"),
        CLOSURE_SQL,
        LATEST_SQL,
        """failures AS (SELECT l.run_id, o.stage, l.scope FROM latest l JOIN op_stages o
  ON o.operation = l.operation WHERE l.status <> 'succeeded' AND l.round = 2),
excluded AS (SELECT f.run_id, c.stage FROM failures f JOIN closure c ON c.root = f.stage
  UNION SELECT run_id, stage FROM runs, (SELECT 'correction_transcript' AS stage UNION
    SELECT stage FROM closure WHERE root = 'correction_transcript') s
  WHERE status = 'succeeded' AND run_id NOT IN (SELECT run_id FROM latest WHERE status <> 'succeeded' AND round = 2)
    AND run_id NOT IN (SELECT run_id FROM preparations WHERE round = 2 AND status = 'unavailable'))""",
    )
    + """SELECT k.run_id, k.stage, k.scope, k.artifact_id FROM checkpoints k WHERE k.round = 2
AND NOT EXISTS (SELECT 1 FROM excluded e WHERE e.run_id = k.run_id AND e.stage = k.stage)
AND NOT EXISTS (SELECT 1 FROM failures f WHERE f.run_id = k.run_id AND f.stage = k.stage
                AND f.scope = k.scope)
AND k.run_id NOT IN (SELECT run_id FROM latest WHERE status <> 'succeeded' AND round = 2
                     AND operation NOT IN (SELECT operation FROM op_stages))""",
)
def retry_carryover(spark: SparkSession, folder: str) -> DataFrame:
    latest = L.latest_attempts(
        recipe(spark, folder, "invocations").where(F.col("round") == 2)
    )
    prior = recipe(spark, folder, "checkpoints").where(F.col("round") == 2)
    kept = L.retry_carryover(
        prior, latest, recipe(spark, folder, "runs"), L.stage_closure(spark),
        L.operation_stages(spark),
        recipe(spark, folder, "preparations").where("round = 2 and status = 'unavailable'"),
    )
    return kept.select("run_id", "stage", "scope", "artifact_id")


@query(
    "latest_attempt",
    with_(recipe_sql("invocations"), LATEST_SQL)
    + "SELECT run_id, round, logical_key, invocation_id, operation, scope, status FROM latest",
)
def latest_attempt(spark: SparkSession, folder: str) -> DataFrame:
    return L.latest_attempts(recipe(spark, folder, "invocations"))


@query(
    "retry_chain",
    with_(
        recipe_sql("invocations"),
        """chain AS (SELECT invocation_id, invocation_id AS root, CAST(0 AS BIGINT) AS depth
  FROM invocations WHERE retry_of IS NULL
  UNION ALL SELECT i.invocation_id, c.root, c.depth + 1 FROM invocations i
  JOIN chain c ON c.invocation_id = i.retry_of)""",
    )
    + """SELECT c.invocation_id, c.root, c.depth, i.retry_of IS NOT NULL AND i.provider <> p.provider
  AS identity_changed FROM chain c JOIN invocations i ON i.invocation_id = c.invocation_id
LEFT JOIN invocations p ON p.invocation_id = i.retry_of""",
)
def retry_chain(spark: SparkSession, folder: str) -> DataFrame:
    return L.retry_chains(recipe(spark, folder, "invocations"), ["provider"])


@query(
    "crash_recovery",
    with_(recipe_sql("invocations", "runs"))
    + """SELECT 'invocation' AS subject, run_id, invocation_id, CASE i.status WHEN 'created'
  THEN 'definitely_not_sent' ELSE 'delivery_ambiguous' END AS new_status
FROM invocations i WHERE status IN ('created', 'sending')
  AND run_id IN (SELECT run_id FROM runs WHERE status = 'running')
UNION ALL SELECT 'run', run_id, NULL, 'interrupted' FROM runs WHERE status = 'running'""",
)
def crash_recovery(spark: SparkSession, folder: str) -> DataFrame:
    return L.crash_recovery(recipe(spark, folder, "runs"), recipe(spark, folder, "invocations"))


@query(
    "usage_ledger",
    with_(recipe_sql("invocations"))
    + """SELECT run_id, provider, count(*) AS attempts,
  count(*) FILTER (status = 'succeeded') AS succeeded,
  CAST(sum(CAST(json_extract_string(usage_json, '$.k') AS BIGINT)) FILTER (usage_json <> 'null')
    AS BIGINT) AS known_usage,
  count(*) FILTER (usage_json IS NULL OR usage_json = 'null') AS unknown_usage
FROM invocations GROUP BY run_id, provider""",
)
def usage_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return L.usage_ledger(recipe(spark, folder, "invocations"))


@query(
    "reference_latest",
    with_(
        recipe_sql("preparations"),
        """firsts AS (SELECT * FROM preparations WHERE round <= 3 QUALIFY row_number() OVER (
  PARTITION BY run_id, ordinal, round ORDER BY seq) = 1),
latest AS (SELECT *, CASE WHEN status = 'available' THEN newest - round ELSE 0 END AS later_rounds
  FROM (SELECT *, max(round) OVER (PARTITION BY run_id, ordinal) AS newest FROM firsts)
  QUALIFY row_number() OVER (PARTITION BY run_id, ordinal
    ORDER BY status <> 'available', CASE WHEN status = 'available' THEN round ELSE -round END) = 1)""",
    )
    + """SELECT run_id, ordinal, round, status, CAST(later_rounds AS BIGINT) AS later_rounds, CASE WHEN status = 'available' THEN row_number()
  OVER (PARTITION BY run_id, status ORDER BY ordinal) - 1 END AS effective_ordinal FROM latest""",
)
def reference_latest(spark: SparkSession, folder: str) -> DataFrame:
    return L.latest_references(recipe(spark, folder, "preparations"), 3)


@query(
    "checkpoint_upsert",
    with_(recipe_sql("upserts"))
    + """SELECT run_id, round, stage, scope, arg_max(artifact_id, seq) AS artifact_id,
  count(*) FILTER (prior IS NULL OR prior <> artifact_id) AS revision,
  CASE WHEN count(DISTINCT input_digest) > 1 THEN 'input_changed'
    WHEN bool_or(artifact_stage <> stage) THEN 'kind_mismatch' ELSE 'stored' END AS outcome
FROM (SELECT *, lag(artifact_id) OVER (PARTITION BY run_id, round, stage, scope ORDER BY seq)
      AS prior FROM upserts) GROUP BY run_id, round, stage, scope""",
)
def checkpoint_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return L.checkpoint_upsert(recipe(spark, folder, "upserts"))


@query(
    "run_status",
    with_(recipe_sql("progress", "runs"))
    + """SELECT run_id, arg_max(status, event_id) AS status, arg_max(stage, event_id) AS stage,
  count(*) FILTER (status = 'paused') AS unknown_states FROM progress
WHERE run_id IN (SELECT run_id FROM runs WHERE project_id IS NULL) GROUP BY run_id""",
)
def run_status(spark: SparkSession, folder: str) -> DataFrame:
    return L.run_status(
        recipe(spark, folder, "progress"), recipe(spark, folder, "runs"),
        F.lit(None).cast("string"),
    )


@query(
    "orphan_objects",
    with_(recipe_sql("transfers", "transfer_runs"))
    + """SELECT t.run_id, t.transfer_id, CASE WHEN t.run_id IN (SELECT run_id FROM transfers WHERE transfer_id % 91 = 0)
  THEN 'unreadable' WHEN r.status = 'running' THEN 'active_run'
  WHEN t.state = 'bound' OR (t.transfer_id % 3 = 0) THEN 'protected'
  ELSE 'would_remove' END AS action
FROM transfers t JOIN transfer_runs r ON r.run_id = t.run_id""",
)
def orphan_objects(spark: SparkSession, folder: str) -> DataFrame:
    transfers = recipe(spark, folder, "transfers")
    entry = F.to_json(F.struct("object_key"))
    documents = transfers.where(F.col("transfer_id") % 3 == 0).select(
        "run_id",
        F.concat(F.lit('{"kind":"reference","items":[{"object":'), entry, F.lit("}]}")).alias("body"),
    )
    malformed = transfers.where(F.col("transfer_id") % 91 == 0).select("run_id", F.lit('{"kind":').alias("body"))
    documents = documents.unionByName(malformed)
    return L.orphan_objects(transfers, documents, recipe(spark, folder, "transfer_runs"))


@query(
    "transfer_resume",
    with_(recipe_sql("transfers"))
    + """SELECT i.run_id, i.purpose, i.content_hash, t.transfer_id,
  CASE WHEN t.transfer_id IS NULL THEN 'new_upload'
    WHEN t.state IN ('persisted', 'bound') THEN 'reuse'
    WHEN t.transfer_id % 8 = 0 THEN 'adopt_stored' ELSE 'upload_same_key' END AS action
FROM (SELECT DISTINCT run_id, purpose, content_hash FROM transfers) i
LEFT JOIN (SELECT * FROM transfers WHERE state <> 'removed' QUALIFY row_number() OVER (
  PARTITION BY run_id, purpose, content_hash ORDER BY created_at DESC, transfer_id DESC) = 1) t
ON t.run_id = i.run_id AND t.purpose = i.purpose AND t.content_hash = i.content_hash""",
)
def transfer_resume(spark: SparkSession, folder: str) -> DataFrame:
    transfers = recipe(spark, folder, "transfers")
    listing = transfers.where(F.col("transfer_id") % 8 == 0).select("object_key")
    return L.transfer_resume(transfers, transfers, listing)


@query(
    "run_result_json",
    with_(recipe_sql("invocations", "runs"))
    + """SELECT p.run_id, p.round, p.part, CAST(to_json({'contract_version': '1.0',
  'run_id': p.run_id, 'project_id': r.project_id, 'execution_round': p.round,
  'status': r.status, 'usage': {'invocations': p.calls},
  'error': CASE r.status WHEN 'interrupted' THEN 'interrupted' WHEN 'failed' THEN 'run_failed' END
  }) AS VARCHAR) AS result_json
FROM (SELECT run_id, round, invocation_id // 1000 AS part, list({'invocation_id': invocation_id,
        'status': status,
        'usage': CAST(json_extract_string(usage_json, '$.k') AS BIGINT)} ORDER BY invocation_id)
        AS calls FROM invocations GROUP BY ALL) p
JOIN runs r ON r.run_id = p.run_id""",
)
def run_result_json(spark: SparkSession, folder: str) -> DataFrame:
    return L.run_results(recipe(spark, folder, "runs"), recipe(spark, folder, "invocations"))


@query(
    "golden_compare",
    with_(
        recipe_sql("artifacts"),
        "gold AS (SELECT run_id, artifact_id, kind, content_hash FROM artifacts)",
        "seen AS (SELECT run_id, artifact_id, kind, CASE WHEN artifact_id % 211 = 0 THEN 'forged' "
        "ELSE content_hash END AS content_hash FROM gold WHERE artifact_id % 223 <> 0)",
    )
    + """SELECT *, 'stored' AS side FROM (SELECT * FROM seen EXCEPT ALL SELECT * FROM gold)
UNION ALL SELECT *, 'recomputed' FROM (SELECT * FROM gold EXCEPT ALL SELECT * FROM seen)""",
)
def golden_compare(spark: SparkSession, folder: str) -> DataFrame:
    gold = recipe(spark, folder, "artifacts").select("run_id", "artifact_id", "kind", "content_hash")
    seen = gold.where(F.col("artifact_id") % 223 != 0).withColumn(
        "content_hash",
        F.when(F.col("artifact_id") % 211 == 0, "forged").otherwise(F.col("content_hash")),
    )
    return plan_audit(seen, gold)


@query(
    "export_provenance_audit",
    """SELECT o_orderkey AS run_id, CASE o_orderkey % 17 WHEN 1 THEN 'not_current'
  WHEN 2 THEN 'checkpoint' WHEN 3 THEN 'not_sealed' WHEN 4 THEN 'media_bytes' WHEN 5 THEN 'inputs'
  WHEN 6 THEN 'call' WHEN 7 THEN 'text' ELSE 'not_current,checkpoint' END AS codes
FROM orders WHERE o_orderkey % 17 BETWEEN 1 AND 8""",
)
def export_provenance_audit(spark: SparkSession, folder: str) -> DataFrame:
    base = recipe(spark, folder, "export_base")
    fault, own = F.col("fault"), F.col("artifact_id")
    exports = base.select(
        "run_id", "artifact_id", "audio_hash",
        F.when(fault == 5, "transcript,media_object,timeline_audio")
        .otherwise("media_object,timeline_audio,transcript")
        .alias("input_roles"),
        F.when(fault == 7, F.concat("sealed_text", F.lit("?")))
        .otherwise(F.col("sealed_text"))
        .alias("request_text"),
    )
    pointers = base.where(fault != 8).select("run_id", "artifact_id", (fault == 1).alias("is_stale"))
    checkpoints = base.where(fault != 8).select(
        "run_id", F.when(fault == 2, own + 1).otherwise(own).alias("checkpoint_artifact_id")
    )
    resolutions = base.select(
        "run_id", (fault != 3).alias("sealed"), F.lit(0).alias("pending"), "sealed_text"
    )
    media = base.select(
        "run_id",
        F.when(fault == 4, "other").otherwise(F.col("audio_hash")).alias("media_hash"),
    )
    calls = base.select(
        "run_id", F.when(fault == 6, "explicit_failure").otherwise("succeeded").alias("call_status")
    )
    return L.export_audit(exports, pointers, checkpoints, resolutions, media, calls)


@query(
    "latency_quantiles",
    """WITH s AS (SELECT event_type AS operation, CAST(round(value * 100) AS BIGINT) AS value,
  row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT operation, max(n) AS samples, max(value) FILTER (r = (n + 1) // 2)
  + max(value) FILTER (r = n // 2 + 1) AS median_x2,
  max(value) FILTER (r = greatest(CAST(round_even(n * 95 / 100.0, 0) AS BIGINT), 1)) AS p95,
  max(value) AS largest FROM s GROUP BY operation""",
)
def latency_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    samples = table(spark, folder, "events").select(
        F.col("event_type").alias("operation"),
        F.round(F.col("value") * 100).cast("long").alias("value"),
    )
    return L.latency_quantiles(samples)


QUERIES, ORACLES = registry.queries, registry.oracles
