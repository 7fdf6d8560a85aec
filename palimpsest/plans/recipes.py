"""Derived tables written once as SQL text that both Spark and the oracle can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.tables import table, wall_ms

# name -> (source tables, SQL with {source} placeholders). `ev` is events plus epoch `ms`.
RECIPES: dict[str, tuple[tuple[str, ...], str]] = {}
EV_SQL = "ev AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ms", wall_ms(F.col("ts")))


def recipe(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sources, text = RECIPES[name]
    frames = {}
    for source in sources:
        if source == "ev":
            frames[source] = events(spark, folder)
        elif source in RECIPES:
            frames[source] = recipe(spark, folder, source)
        else:
            frames[source] = table(spark, folder, source)
    return spark.sql(text, **frames)


def recipe_sql(*names: str) -> str:
    """The recipes as a `WITH` list for the oracle, each once, sources first."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        if name == "ev":
            done[name] = EV_SQL
        elif name in RECIPES:
            sources, text = RECIPES[name]
            for source in sources:
                add(source)
            done[name] = f"{name} AS ({text.format(**{s: s for s in sources})})"

    for name in names:
        add(name)
    return ",\n".join(done.values())


_STAGES = (
    "job_input", "media_probe", "timeline_audio", "media_object", "base_asr", "peer_asr",
    "asr_comparison", "correction_transcript", "merge_plan", "selection_batch",
    "selection_result", "edit_resolution", "review_queue", "transcript", "ata_response",
    "ata_result",
)
_STAGE_CASE = (
    "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STAGES)) + " END"
)

RECIPES["invocations"] = (("ev",), """
SELECT event_id AS invocation_id, user_id AS run_id, 1 + event_id % 2 AS round, operation, scope,
       operation || ':' || scope AS logical_key, status, provider, usage_json, retry_of,
       ms AS created_at
FROM (SELECT *, CASE event_type WHEN 'view' THEN 'media_upload' WHEN 'error' THEN 'correction_a'
        WHEN 'signup' THEN 'correction_b' WHEN 'click' THEN 'selection'
        ELSE CASE event_id % 5 WHEN 0 THEN 'transcribe_base' WHEN 1 THEN 'transcribe_peer'
          WHEN 2 THEN 'unlisted_call' ELSE 'alignment' END END AS operation,
      CASE event_type WHEN 'error' THEN 'a' WHEN 'signup' THEN 'b'
        WHEN 'click' THEN 'batch_' || CAST(event_id % 3 AS STRING) ELSE 'global' END AS scope,
      CASE event_id % 40 WHEN 0 THEN 'created' WHEN 1 THEN 'sending' WHEN 2 THEN 'explicit_failure'
        WHEN 3 THEN 'delivery_ambiguous' WHEN 4 THEN 'definitely_not_sent' ELSE 'succeeded' END
        AS status,
      CASE WHEN event_id % 97 = 0 THEN 'other' ELSE 'p' || CAST(event_id % 7 AS STRING) END
        AS provider,
      CASE WHEN event_id % 10 = 0 THEN 'null' WHEN value > 10 THEN props END AS usage_json,
      CASE WHEN floor(event_id / 7.0) % 40 <> 0 THEN event_id - 7 END AS retry_of
      FROM {ev}) x""")
RECIPES["runs"] = (("ev",), """
SELECT run_id, CASE run_id % 4 WHEN 0 THEN NULL ELSE 'project_' || CAST(run_id % 4 AS STRING) END
         AS project_id,
       CASE run_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'interrupted'
         ELSE 'succeeded' END AS status
FROM (SELECT DISTINCT user_id AS run_id FROM {ev}) x""")
RECIPES["progress"] = (("ev",), """
SELECT event_id, user_id AS run_id, event_type AS stage,
       CASE event_id % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'needs_review'
         WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed' WHEN 5 THEN 'cancelled'
         WHEN 6 THEN 'interrupted' ELSE 'paused' END AS status FROM {ev}""")
RECIPES["checkpoints"] = (("ev",), f"""
SELECT run_id, stage, scope, round, max(event_id) AS artifact_id
FROM (SELECT event_id, user_id AS run_id, {_STAGE_CASE} AS stage,
             CASE WHEN event_id % 16 = 7 THEN CASE WHEN value > 30 THEN 'a' ELSE 'b' END
               WHEN event_id % 16 IN (9, 10) THEN 'batch_' || CAST(event_id % 3 AS STRING)
               ELSE 'global' END AS scope,
             CASE WHEN event_id % 16 BETWEEN 1 AND 6 THEN 0
               WHEN value > 20 THEN 2 ELSE 1 END AS round FROM {{ev}}) x
GROUP BY run_id, stage, scope, round""")
RECIPES["pointers"] = (("checkpoints",), """
SELECT run_id, stage, scope, max(artifact_id) AS artifact_id FROM {checkpoints}
GROUP BY run_id, stage, scope""")
RECIPES["roots"] = (("runs",), """
SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'correction_transcript' ELSE 'base_asr' END AS stage
FROM {runs} WHERE run_id % 5 < 2""")
RECIPES["artifacts"] = (("lineitem",), """
SELECT l_orderkey AS run_id, l_orderkey * 100 + l_linenumber AS artifact_id,
       min(l_linenumber) AS place, 'kind_' || CAST(min(l_partkey) % 4 AS STRING) AS kind,
       'hash_' || CAST(min(l_partkey) AS STRING) AS content_hash, min(l_partkey) AS created_at
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""")
RECIPES["inputs"] = (("artifacts",), """
SELECT run_id, artifact_id, 0 AS ordinal,
       CASE WHEN created_at % 103 = 0 THEN NULL WHEN place > 1 THEN artifact_id - 1
         WHEN created_at % 10 = 0 THEN -created_at END AS input_artifact_id,
       CASE WHEN created_at % 103 = 0 THEN NULL WHEN created_at % 101 = 0 THEN 'src_extra'
         WHEN place = 1 AND created_at % 10 <> 0 THEN 'src_' || CAST(created_at AS STRING) END
         AS input_source_id FROM {artifacts}""")
RECIPES["marks"] = (("ev",), """
SELECT event_id AS seq, user_id AS run_id, 'kind_' || CAST(event_id % 3 AS STRING) AS kind,
       CASE WHEN event_type <> 'signup' THEN 'scope_' || CAST(event_id % 2 AS STRING) END AS scope,
       'art_' || CAST(event_id AS STRING) AS artifact_id,
       event_type NOT IN ('error', 'signup') AS activates FROM {ev}""")
RECIPES["preparations"] = (("ev",), """
SELECT event_id AS seq, user_id AS run_id, event_id % 8 AS ordinal,
       1 + CAST(floor(event_id / 8.0) AS BIGINT) % 4 AS round,
       CASE WHEN value > 40 THEN 'available' ELSE 'unavailable' END AS status FROM {ev}""")
RECIPES["upserts"] = (("ev",), f"""
SELECT event_id AS seq, user_id AS run_id, 1 + event_id % 2 AS round, {_STAGE_CASE} AS stage,
       'global' AS scope, 'art_' || CAST(event_id % 3 AS STRING) AS artifact_id,
       CASE WHEN event_id % 397 = 0 THEN 'changed' ELSE 'digest' END AS input_digest,
       CASE WHEN event_id % 401 = 0 THEN 'other' ELSE {_STAGE_CASE} END AS artifact_stage
FROM {{ev}}""")
RECIPES["transfers"] = (("pages",), """
SELECT page_id AS transfer_id, page_id % 20 AS run_id,
       'purpose_' || CAST(page_id % 3 AS STRING) AS purpose,
       'hash_' || CAST(page_id % 40 AS STRING) AS content_hash,
       'objects/' || CAST(page_id AS STRING) || '.bin' AS object_key,
       CASE page_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'persisted' WHEN 2 THEN 'bound'
         ELSE 'removed' END AS state, page_id AS created_at FROM {pages}""")
RECIPES["transfer_runs"] = (("transfers",), """
SELECT DISTINCT run_id, CASE WHEN run_id % 7 = 0 THEN 'running' ELSE 'succeeded' END AS status
FROM {transfers}""")
RECIPES["export_base"] = (("orders",), """
SELECT o_orderkey AS run_id, o_orderkey * 10 AS artifact_id, o_orderkey % 17 AS fault,
       'hash_' || CAST(o_custkey AS STRING) AS audio_hash, o_orderpriority AS sealed_text
FROM {orders}""")


# Accounts. A family is (user, block of 1,000 event ids), so it has at most 1,000 sessions.
RECIPES["sessions"] = (("ev",), """
SELECT event_id AS session_id, user_id, user_id * 1000000 + CAST(floor(event_id / 1000.0) AS BIGINT)
         AS family_id, ms AS created_at, ms + 2592000000 AS expires_at,
       CASE WHEN next_id IS NOT NULL THEN next_ms WHEN event_id % 13 = 0 THEN ms + 1000 END
         AS revoked_at, next_id AS replaced_by, value, event_type
FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id, floor(event_id / 1000.0)
               ORDER BY event_id) AS next_id,
             lead(ms) OVER (PARTITION BY user_id, floor(event_id / 1000.0) ORDER BY event_id)
               AS next_ms FROM {ev}) x""")
RECIPES["families"] = (("sessions",), """
SELECT family_id, min(user_id) AS user_id, min(created_at) AS created_at,
       CASE WHEN family_id % 11 = 0 THEN max(created_at) END AS revoked_at
FROM {sessions} GROUP BY family_id""")
RECIPES["session_users"] = (("ev",), """
SELECT user_id, CASE WHEN user_id % 10 = 3 THEN 'suspended' ELSE 'active' END AS user_status,
       CASE WHEN user_id % 10 = 4 THEN NULL WHEN user_id % 10 = 5 THEN 'blocked'
         ELSE 'normal' END AS phone_status
FROM (SELECT DISTINCT user_id FROM {ev}) x""")
RECIPES["access_tokens"] = (("sessions",), """
SELECT session_id * 10 AS token_id, session_id, user_id, created_at,
       created_at + 900000 AS expires_at,
       CASE WHEN session_id % 17 = 0 THEN created_at + 1 END AS revoked_at FROM {sessions}""")
RECIPES["attempts"] = (("ev",), """
SELECT user_id AS bucket_key, event_type AS purpose, event_id,
       CAST(floor(ms / 600.0) AS BIGINT) AS ts_ms FROM {ev}""")
RECIPES["sign_ins"] = (("ev",), """
SELECT event_id, CAST(floor(ms / 600.0) AS BIGINT) AS ts_ms, event_type AS purpose, value > 80 AS valid,
       user_id AS phone, user_id * 3 + event_id % 3 AS client, user_id % 97 AS ip FROM {ev}""")
RECIPES["challenge_events"] = (("ev",), """
SELECT event_id, user_id * 1000000 + CAST(floor(event_id / 100.0) AS BIGINT) AS challenge_id,
       ms AS ts_ms, value > 80 AS correct,
       CASE WHEN event_id % 17 = 0 THEN user_id + 1 ELSE user_id END AS phone,
       CASE WHEN event_id % 19 = 0 THEN 'phone_change' ELSE 'login' END AS purpose FROM {ev}""")
RECIPES["challenges"] = (("challenge_events",), """
SELECT challenge_id, min(ts_ms) AS created_at,
       CAST(floor(challenge_id / 1000000.0) AS BIGINT) AS phone, 'login' AS purpose,
       min(ts_ms) + CASE WHEN challenge_id % 3 = 0 THEN 300000 ELSE 30000000 END AS expires_at
FROM {challenge_events} GROUP BY challenge_id""")
RECIPES["grants"] = (("ev",), """
SELECT event_id AS grant_id, event_id AS challenge_id, user_id,
       CASE WHEN event_id % 23 = 0 THEN 'key_x' ELSE 'key_' || CAST(user_id AS STRING) END
         AS phone_key,
       CASE WHEN event_id % 29 = 0 THEN 'phone_change' ELSE 'password_reset' END AS purpose,
       ms AS created_at, ms + 600000 AS expires_at,
       CASE WHEN value > 60 THEN ms + CAST(floor(value * 5000) AS BIGINT) END AS consumed_at,
       CASE WHEN event_id % 31 = 0 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END AS uses FROM {ev}""")
RECIPES["grant_challenges"] = (("ev",), """
SELECT event_id AS challenge_id, user_id, 'key_' || CAST(user_id AS STRING) AS phone_key,
       'password_reset' AS purpose FROM {ev}""")
RECIPES["users"] = (("customer",), """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN 'suspended' ELSE 'active' END
         AS status FROM {customer}""")
RECIPES["identities"] = (("customer",), """
SELECT c_custkey * 10 AS identity_id, c_custkey AS user_id, 'phone' AS provider,
       CASE WHEN c_custkey % 97 = 0 THEN '0' || CAST(c_custkey AS STRING)
         ELSE '+86' || lpad(CAST(c_custkey AS STRING), 11, '0') END AS subject,
       CASE WHEN c_custkey % 41 = 0 THEN 'detached' ELSE 'active' END AS status,
       CASE WHEN c_custkey % 41 = 0 THEN c_custkey * 10 + 2 END AS replaced_by,
       CASE WHEN c_custkey % 19 = 0 THEN 'blocked' ELSE 'normal' END AS phone_status
FROM {customer}
UNION ALL
SELECT c_custkey * 10 + 1, c_custkey, 'phone',
       '+87' || lpad(CAST(c_custkey AS STRING), 11, '0'), 'active', NULL, 'normal'
FROM {customer} WHERE c_custkey % 53 = 0
UNION ALL
SELECT c_custkey * 10 + 2, c_custkey, 'phone',
       '+88' || lpad(CAST(c_custkey AS STRING), 11, '0'),
       CASE WHEN c_custkey % 82 = 0 THEN 'detached' ELSE 'active' END,
       CASE WHEN c_custkey % 82 = 0 THEN c_custkey * 10 + 3 END, 'normal'
FROM {customer} WHERE c_custkey % 41 = 0
UNION ALL
SELECT c_custkey * 10 + 3, c_custkey, 'phone',
       '+89' || lpad(CAST(c_custkey AS STRING), 11, '0'), 'active', NULL, 'normal'
FROM {customer} WHERE c_custkey % 82 = 0
UNION ALL
SELECT c_custkey * 10 + 4, c_custkey, 'email',
       CASE WHEN c_custkey % 43 = 0 THEN 'shared@example.org'
         ELSE 'user' || CAST(c_custkey AS STRING) || '@example.org' END, 'active', NULL, NULL
FROM {customer} WHERE c_nationkey < 12""")
RECIPES["credentials"] = (("customer",), """
SELECT c_custkey AS user_id FROM {customer} WHERE c_custkey % 31 <> 0""")
RECIPES["bans"] = (("customer",), """
SELECT c_custkey AS ban_id, c_custkey AS user_id,
       CASE WHEN c_custkey % 21 = 0 THEN c_custkey END AS overturned_at
FROM {customer} WHERE c_custkey % 7 = 0 OR c_custkey % 8 = 0""")
