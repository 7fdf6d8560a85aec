"""Registered timeline, session, identity and rate-limit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.ordered import running
from palimpsest.operators import accounts as A
from palimpsest.operators import rate_limit, timeline
from palimpsest.plans.recipes import EV_SQL, events, recipe, recipe_sql
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import table

registry = Registry()
query = registry.query

NOW = 1705363200000
_DUCK_INT = "CAST({} AS BIGINT)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


PACKETS_SQL = f"""{EV_SQL}, packets AS (SELECT stream_id, n AS ordinal,
  CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN n * 1024 + 512
    WHEN event_id % 107 = 0 THEN n * 1024 - 100 ELSE n * 1024 END AS pts, 1024 AS duration
  FROM (SELECT user_id AS stream_id, event_id,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM ev))"""


def packets(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).select(
        F.col("user_id").alias("stream_id"), "event_id",
        F.floor(F.col("event_id") / (1 << 20)).alias("part"),
    )
    numbered = running(rows, ["stream_id"], ["event_id"], "part", n=("sum", F.lit(1)))
    n, e = F.col("n") - 1, F.col("event_id")
    return numbered.select(
        "stream_id",
        n.alias("ordinal"),
        F.when(e % 101 == 0, None)
        .when(e % 103 == 0, n * 1024 + 512)
        .when(e % 107 == 0, n * 1024 - 100)
        .otherwise(n * 1024)
        .alias("pts"),
        F.lit(1024).cast("long").alias("duration"),
    )


@query(
    "packet_continuity",
    with_(
        PACKETS_SQL,
        """flagged AS (SELECT *, CASE WHEN pts IS NULL THEN 'timestamp_unavailable'
  WHEN pts < expected THEN 'backward_jump' WHEN pts > expected THEN 'gap' END AS code
  FROM (SELECT *, lag(pts + duration) OVER (PARTITION BY stream_id ORDER BY ordinal) AS expected
        FROM packets))""",
    )
    + """SELECT c.stream_id, CASE WHEN f.code IS NULL THEN 'continuous' ELSE 'discontinuous' END
  AS status, n AS packets_scanned, f.code, f.ordinal AS packet_ordinal,
  CASE WHEN f.code <> 'timestamp_unavailable' THEN f.expected END AS expected,
  CASE WHEN f.code <> 'timestamp_unavailable' THEN f.pts END AS observed
FROM (SELECT stream_id, count(*) AS n FROM packets GROUP BY stream_id) c
LEFT JOIN (SELECT * FROM flagged WHERE code IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY stream_id ORDER BY ordinal) = 1) f ON f.stream_id = c.stream_id""",
)
def packet_continuity(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.packet_continuity(packets(spark, folder))


_ORIGIN_SQL = """origins AS (
  SELECT l_orderkey AS stream_id,
    min(l_partkey) FILTER (l_linenumber % 2 = 0) AS v_num,
    CASE WHEN bool_or(l_linenumber % 2 = 0) THEN 90000 END AS v_den,
    min(l_partkey * 48000 + CAST(l_quantity AS BIGINT) * 100 * 48000)
      FILTER (l_linenumber % 2 = 1 AND l_quantity * 100 < 1024) AS a_num,
    CASE WHEN bool_or(l_linenumber % 2 = 1) THEN 48000::BIGINT * 48000 END AS a_den,
    bool_or(l_linenumber % 2 = 0) AS has_video FROM lineitem GROUP BY l_orderkey),
offsets AS (SELECT *, CASE WHEN NOT has_video AND a_num IS NOT NULL THEN 0
    ELSE a_num::HUGEINT * v_den - v_num::HUGEINT * a_den END AS offset_num,
  CASE WHEN has_video THEN a_den::HUGEINT * v_den ELSE a_den END AS den FROM origins)"""


def _origins(spark: SparkSession, folder: str) -> DataFrame:
    video = F.col("l_linenumber") % 2 == 0
    frames = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"),
        F.when(video, "video").otherwise("audio").alias("media_type"),
        F.col("l_partkey").alias("pts"),
        (F.col("l_quantity").cast("long") * 100).alias("skip_samples"),
        F.lit(1024).alias("nb_samples"),
        F.lit(48_000).cast("long").alias("sample_rate"),
        F.lit(1).alias("tb_num"),
        F.when(video, 90_000).otherwise(48_000).cast("long").alias("tb_den"),
    )
    return timeline.timeline_origin(frames)


@query(
    "timeline_origin",
    with_(_ORIGIN_SQL)
    + "SELECT stream_id, v_num, v_den, a_num, a_den, offset_num, "
    "CASE WHEN offset_num IS NOT NULL THEN den END AS offset_den FROM offsets",
)
def timeline_origin(spark: SparkSession, folder: str) -> DataFrame:
    rows = _origins(spark, folder)
    return rows.select("stream_id", *[F.col(c).cast("decimal(38,0)") for c in rows.columns[1:]])


@query(
    "timeline_actions",
    with_(
        _ORIGIN_SQL,
        """q AS (SELECT stream_id, CASE WHEN offset_num IS NOT NULL THEN
    sign(offset_num) * ((abs(offset_num) * 16000) // den
      + CASE WHEN ((abs(offset_num) * 16000) % den) * 2 >= den THEN 1 ELSE 0 END) END AS n,
  CASE WHEN stream_id % 9 = 0 THEN 'audio_timestamp_gap' END AS broken FROM offsets)""",
    )
    + """SELECT stream_id, CASE WHEN n IS NULL OR broken IS NOT NULL THEN 'unverified'
    WHEN n = 0 THEN 'normal' ELSE 'corrected' END AS timeline_status,
  CASE WHEN n IS NULL THEN 'timeline_origin_unverified' WHEN n > 0 THEN 'pad_silence_before'
    WHEN n < 0 THEN 'trim_before_timeline' ELSE 'timeline_origin_unchanged' END AS action,
  CAST(CASE WHEN n <> 0 THEN abs(n) END AS BIGINT) AS sample_count, stream_id * 10 + 1 AS total_samples,
  concat_ws(',', CASE WHEN n IS NULL THEN 'opening_presentation_timestamp_unavailable' END,
    CASE WHEN n > 0 THEN 'audio_starts_after_media' WHEN n < 0 THEN 'audio_starts_before_media' END,
    broken) AS issues FROM q""",
)
def timeline_actions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _origins(spark, folder).select(
        "stream_id", "offset_num", "offset_den",
        (F.col("stream_id") * 10 + 1).alias("total_samples"),
        F.when(F.col("stream_id") % 9 == 0, "audio_timestamp_gap").alias("continuity_code"),
    )
    return timeline.timeline_actions(rows)


@query(
    "duration_authority",
    """WITH m AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS video,
    CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey * 977 END
      ELSE CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey * 433 END END AS ticks,
    CASE WHEN o_orderkey % 3 <> 0 THEN 90000 ELSE 48000 END AS den,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS d1,
    CAST(o_custkey AS BIGINT) * 1000 AS d2 FROM orders),
n AS (SELECT *, ticks > 0 AS clocked, CASE WHEN ticks > 0 THEN ticks ELSE
    coalesce(nullif(d1, 0) * 10000, d2 * 1000) END AS top,
  CASE WHEN ticks > 0 THEN den ELSE 1000000 END AS bottom FROM m),
s AS (SELECT *, top * 16000 // bottom + CASE WHEN (top * 16000 % bottom) * 2 >= bottom THEN 1
  ELSE 0 END AS samples FROM n)
SELECT k AS media_id, CASE WHEN video THEN 'video' ELSE 'audio' END AS authority,
  CASE WHEN clocked THEN 'stream_clock' ELSE 'decimal_text' END AS source,
  CASE WHEN samples > 0 THEN samples END AS total_samples,
  CASE WHEN samples > 0 THEN (samples * 1000 + 8000) // 16000 END AS duration_ms FROM s""",
)
def duration_authority(spark: SparkSession, folder: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    text = F.when(k % 10 != 0, (cents.cast("decimal(18,0)") / 100).cast("decimal(20,2)").cast("string"))
    media = table(spark, folder, "orders").select(
        k.alias("media_id"),
        (k % 3 != 0).alias("video_present"),
        F.when(k % 5 != 0, c * 977).alias("video_duration_ts"),
        F.lit(1).alias("video_tb_num"),
        F.lit(90_000).alias("video_tb_den"),
        text.alias("video_duration"),
        F.when(k % 7 != 0, c * 433).alias("audio_duration_ts"),
        F.lit(1).alias("audio_tb_num"),
        F.lit(48_000).alias("audio_tb_den"),
        text.alias("audio_duration"),
        c.cast("string").alias("container_duration"),
    )
    return timeline.duration_authority(media)


def _sessions(spark: SparkSession, folder: str, *names: str):
    return [recipe(spark, folder, n) for n in names]


@query(
    "active_sessions",
    with_(recipe_sql("sessions", "families", "session_users", "access_tokens"))
    + f"""SELECT s.session_id, s.user_id, s.family_id, coalesce(t.n, 0) AS live_tokens
FROM sessions s JOIN families f ON f.family_id = s.family_id
JOIN session_users u ON u.user_id = s.user_id
LEFT JOIN (SELECT session_id, count(*) AS n FROM access_tokens WHERE revoked_at IS NULL
  AND {NOW} < expires_at GROUP BY session_id) t ON t.session_id = s.session_id
WHERE s.revoked_at IS NULL AND s.replaced_by IS NULL AND {NOW} < s.expires_at
  AND f.revoked_at IS NULL AND {NOW} < f.created_at + {A.FAMILY_TTL_MS}
  AND u.user_status = 'active' AND u.phone_status = 'normal'""",
)
def active_sessions(spark: SparkSession, folder: str) -> DataFrame:
    tables = _sessions(spark, folder, "sessions", "families", "session_users", "access_tokens")
    return A.active_sessions(*tables, NOW)


@query(
    "session_eviction",
    with_(recipe_sql("sessions", "families"))
    + f"""SELECT user_id, family_id, created_at FROM (SELECT f.*, row_number() OVER (
    PARTITION BY user_id ORDER BY created_at DESC, family_id DESC) AS n FROM families f
  WHERE revoked_at IS NULL AND created_at + {A.FAMILY_TTL_MS} > {NOW} AND EXISTS (
    SELECT 1 FROM sessions s WHERE s.family_id = f.family_id AND s.revoked_at IS NULL
      AND s.replaced_by IS NULL AND s.expires_at > {NOW})) WHERE n > 4""",
)
def session_eviction(spark: SparkSession, folder: str) -> DataFrame:
    sessions, families = _sessions(spark, folder, "sessions", "families")
    return A.evicted_families(families, sessions, NOW)


@query(
    "refresh_reuse",
    with_(
        recipe_sql("sessions", "access_tokens"),
        """uses AS (SELECT session_id, created_at + CAST(floor(value * 100000000) AS BIGINT)
  AS used_at FROM sessions),
firsts AS (SELECT family_id, min(used_at) AS reused_at FROM uses u
  JOIN sessions s ON s.session_id = u.session_id
  WHERE s.replaced_by IS NOT NULL AND used_at >= s.revoked_at GROUP BY family_id),
hit AS (SELECT s.*, f.reused_at FROM sessions s JOIN firsts f ON f.family_id = s.family_id
  WHERE s.created_at <= f.reused_at)""",
    )
    + """SELECT h.family_id, h.reused_at,
  count(*) FILTER (revoked_at IS NULL OR revoked_at > reused_at) AS sessions_revoked,
  coalesce((SELECT count(*) FROM hit x JOIN access_tokens t ON t.session_id = x.session_id
    WHERE x.family_id = h.family_id AND t.revoked_at IS NULL AND t.created_at <= x.reused_at), 0)
    AS tokens_revoked
FROM hit h GROUP BY h.family_id, h.reused_at""",
)
def refresh_reuse(spark: SparkSession, folder: str) -> DataFrame:
    sessions, tokens = _sessions(spark, folder, "sessions", "access_tokens")
    uses = sessions.select(
        "session_id",
        (F.col("created_at") + F.floor(F.col("value") * 100_000_000)).alias("used_at"),
    )
    return A.refresh_reuse(sessions, uses, tokens)


@query(
    "rotation_chain",
    with_(
        recipe_sql("sessions"),
        "m AS (SELECT s.*, r.replaced_by IS NULL AS is_root FROM sessions s LEFT JOIN "
        "(SELECT DISTINCT replaced_by FROM sessions WHERE replaced_by IS NOT NULL) r "
        "ON r.replaced_by = s.session_id)",
    )
    + """SELECT *, roots = 1 AND live_leaves <= 1 AS sound FROM (
SELECT family_id, count(*) AS sessions, count(*) FILTER (is_root) AS roots,
  min(session_id) FILTER (is_root) AS root_id, max(session_id) FILTER (replaced_by IS NULL) AS leaf_id,
  count(*) FILTER (replaced_by IS NULL AND revoked_at IS NULL) AS live_leaves
FROM m GROUP BY family_id)""",
)
def rotation_chain(spark: SparkSession, folder: str) -> DataFrame:
    return A.rotation_chains(recipe(spark, folder, "sessions"))


LIMIT = 5
def _replay_sql(limit: int | str) -> str:
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY bucket_key, purpose
  ORDER BY ts_ms, event_id) AS rn FROM attempts),
replay AS (
  SELECT bucket_key, purpose, event_id, ts_ms, rn, ts_ms AS started, 1 AS used,
         CAST(0 AS BIGINT) AS cooldown, 'allowed' AS outcome, CAST(0 AS BIGINT) AS wait
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.bucket_key, o.purpose, o.event_id, o.ts_ms, o.rn,
    CASE WHEN o.ts_ms - r.started >= 900000 THEN o.ts_ms ELSE r.started END,
    CASE WHEN o.ts_ms - r.started >= 900000 THEN 1 WHEN o.ts_ms < r.cooldown THEN r.used
         ELSE r.used + 1 END,
    CASE WHEN o.ts_ms - r.started >= 900000 THEN 0 WHEN o.ts_ms < r.cooldown THEN r.cooldown
         WHEN r.used + 1 > {limit} THEN o.ts_ms
           + least(30 * CAST(power(2, r.used - {limit}) AS BIGINT), 900) * 1000 ELSE 0 END,
    CASE WHEN o.ts_ms - r.started >= 900000 THEN 'allowed' WHEN o.ts_ms < r.cooldown
         THEN 'in_cooldown' WHEN r.used + 1 > {limit} THEN 'cooldown_started' ELSE 'allowed' END,
    CASE WHEN o.ts_ms - r.started >= 900000 THEN 0
         WHEN o.ts_ms < r.cooldown THEN greatest(CAST(ceil((r.cooldown - o.ts_ms) / 1000.0) AS BIGINT), 1)
         WHEN r.used + 1 > {limit} THEN least(30 * CAST(power(2, r.used - {limit}) AS BIGINT), 900)
         ELSE 0 END
  FROM replay r JOIN ordered o ON o.bucket_key = r.bucket_key AND o.purpose = r.purpose
    AND o.rn = r.rn + 1)"""


@query(
    "rate_limit_replay",
    with_(recipe_sql("attempts"), _replay_sql(LIMIT))
    + "SELECT bucket_key, purpose, event_id, ts_ms, outcome, wait AS retry_after_s FROM replay",
)
def rate_limit_replay(spark: SparkSession, folder: str) -> DataFrame:
    attempts = recipe(spark, folder, "attempts")
    return rate_limit.rate_limit_replay(attempts, ["bucket_key", "purpose"], LIMIT)


_SHARED = {"client": 8, "ip": 20, "phone": 5}


@query(
    "shared_limit_replay",
    with_(
        recipe_sql("sign_ins"),
        "attempts AS ("
        + " UNION ALL ".join(
            f"SELECT '{kind}:' || {kind} AS bucket_key, purpose, event_id, ts_ms, {limit} AS lim FROM sign_ins"
            for kind, limit in _SHARED.items()
        )
        + ")",
        _replay_sql("o.lim"),
    )
    + """SELECT event_id, min(ts_ms) AS ts_ms, min(purpose) AS purpose, max(wait) AS retry_after_s,
  coalesce(string_agg(split_part(bucket_key, ':', 1), ',' ORDER BY bucket_key) FILTER (wait > 0), '') AS refused_by
FROM replay GROUP BY event_id""",
)
def shared_limit_replay(spark: SparkSession, folder: str) -> DataFrame:
    return rate_limit.shared_limit_replay(recipe(spark, folder, "sign_ins"), _SHARED)


@query(
    "identity_uniqueness",
    with_(recipe_sql("users", "identities", "credentials"))
    + """SELECT provider || ':' || subject AS owner, 'subject_active_twice' AS code, count(*) AS found
FROM identities WHERE status = 'active' GROUP BY provider, subject HAVING count(*) > 1
UNION ALL SELECT CAST(u.user_id AS VARCHAR), 'active_phones', count(i.user_id) FROM users u
LEFT JOIN identities i ON i.user_id = u.user_id AND i.status = 'active' AND i.provider = 'phone'
GROUP BY u.user_id HAVING count(i.user_id) <> 1
UNION ALL SELECT CAST(u.user_id AS VARCHAR), 'passwords', count(c.user_id) FROM users u
LEFT JOIN credentials c ON c.user_id = u.user_id GROUP BY u.user_id HAVING count(c.user_id) <> 1""",
)
def identity_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    return A.identity_uniqueness(*_sessions(spark, folder, "users", "identities", "credentials"))


_OWNED = ("bans", "credentials", "identities", "users")


@query(
    "erasure_plan",
    with_(recipe_sql(*_OWNED), "erased AS (SELECT user_id FROM users WHERE status = 'suspended')")
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) FILTER (user_id IN (SELECT user_id FROM erased)) "
        f"AS rows_to_delete, count(*) FILTER (user_id NOT IN (SELECT user_id FROM erased)) "
        f"AS rows_kept FROM {t}"
        for t in _OWNED
    ),
)
def erasure_plan(spark: SparkSession, folder: str) -> DataFrame:
    tables = {t: recipe(spark, folder, t) for t in _OWNED}
    erased = tables["users"].where(F.col("status") == "suspended")
    return A.erasure_plan(erased, tables)


_EXPIRING = ("access_tokens", "challenges", "grants", "sessions")


@query(
    "expiry_purge",
    with_(recipe_sql(*_EXPIRING))
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) FILTER (expires_at <= {NOW}) AS expired FROM {t}"
        for t in _EXPIRING
    ),
)
def expiry_purge(spark: SparkSession, folder: str) -> DataFrame:
    return A.expiry_purge({t: recipe(spark, folder, t) for t in _EXPIRING}, NOW)


@query(
    "audit_trail",
    with_(EV_SQL)
    + "SELECT user_id, ms AS occurred_at, event_id, event_type, props FROM ev",
)
def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).select(
        "user_id", F.col("ms").alias("occurred_at"), "event_id", "event_type", "props"
    )
    return A.audit_trail(rows)


@query(
    "challenge_replay",
    with_(
        recipe_sql("challenge_events", "challenges"),
        """timed AS (SELECT a.*, c.expires_at, a.correct AND a.phone = c.phone AND a.purpose = c.purpose AS fits
  FROM challenge_events a JOIN challenges c ON c.challenge_id = a.challenge_id),
steps AS (SELECT *, row_number() OVER (PARTITION BY challenge_id ORDER BY ts_ms, event_id) AS n
  FROM timed WHERE ts_ms < expires_at),
walk AS (
  SELECT challenge_id, CAST(0 AS BIGINT) AS n, 5 AS remaining, 'sent' AS status,
         CAST(NULL AS BIGINT) AS verified_at FROM challenges
  UNION ALL
  SELECT w.challenge_id, s.n,
         CASE WHEN w.status = 'sent' AND s.fits THEN w.remaining ELSE greatest(0, w.remaining - 1) END,
         CASE WHEN w.status = 'sent' AND s.fits THEN 'verified'
              WHEN w.remaining <= 1 THEN 'failed' ELSE 'sent' END,
         CASE WHEN w.status = 'sent' AND s.fits THEN s.ts_ms ELSE w.verified_at END
  FROM walk w JOIN steps s ON s.challenge_id = w.challenge_id AND s.n = w.n + 1)""",
    )
    + """SELECT w.challenge_id, CASE WHEN EXISTS (SELECT 1 FROM timed t
    WHERE t.challenge_id = w.challenge_id AND t.ts_ms >= t.expires_at) THEN 'expired'
    ELSE w.status END AS status, CAST(w.remaining AS BIGINT) AS attempts_remaining, w.verified_at
FROM walk w QUALIFY row_number() OVER (PARTITION BY challenge_id ORDER BY n DESC) = 1""",
)
def challenge_replay(spark: SparkSession, folder: str) -> DataFrame:
    return A.challenge_replay(
        recipe(spark, folder, "challenges"), recipe(spark, folder, "challenge_events")
    )


@query(
    "eligible_users",
    with_(recipe_sql("users", "identities", "credentials"))
    + """SELECT u.user_id, i.subject FROM users u
JOIN credentials c ON c.user_id = u.user_id
JOIN identities i ON i.user_id = u.user_id AND i.provider = 'phone' AND i.status = 'active'
WHERE u.status = 'active' AND i.phone_status = 'normal'""",
)
def eligible_users(spark: SparkSession, folder: str) -> DataFrame:
    return A.eligible_users(*_sessions(spark, folder, "users", "identities", "credentials"))


@query(
    "erasure_eligible",
    with_(recipe_sql("users", "identities", "bans"))
    + """SELECT u.user_id, b.ban_id, i.subject FROM users u
JOIN bans b ON b.user_id = u.user_id AND b.overturned_at IS NULL
JOIN identities i ON i.user_id = u.user_id AND i.provider = 'phone' AND i.status = 'active'
WHERE u.status = 'suspended'""",
)
def erasure_eligible(spark: SparkSession, folder: str) -> DataFrame:
    return A.erasure_eligible(*_sessions(spark, folder, "users", "identities", "bans"))


@query(
    "identity_lookup",
    with_(
        recipe_sql("identities"),
        """chain AS (SELECT identity_id, identity_id AS at_, CAST(0 AS BIGINT) AS d FROM identities
  UNION ALL SELECT c.identity_id, i.replaced_by, c.d + 1 FROM chain c
  JOIN identities i ON i.identity_id = c.at_ WHERE i.replaced_by IS NOT NULL)""",
    )
    + """SELECT i.user_id, i.identity_id, i.provider, i.subject, i.status,
  c.at_ AS current_identity_id, c.d AS replacements
FROM identities i JOIN (SELECT * FROM chain QUALIFY row_number() OVER (
  PARTITION BY identity_id ORDER BY d DESC) = 1) c ON c.identity_id = i.identity_id""",
)
def identity_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return A.identity_lookup(recipe(spark, folder, "identities"))


@query(
    "identity_by_subject",
    with_(recipe_sql("identities"))
    + """SELECT a.provider, a.subject, i.identity_id, i.user_id FROM (SELECT DISTINCT provider, subject FROM identities) a
LEFT JOIN identities i ON i.provider = a.provider AND i.subject = a.subject AND i.status = 'active'""",
)
def identity_by_subject(spark: SparkSession, folder: str) -> DataFrame:
    identities = recipe(spark, folder, "identities")
    return A.find_identity(identities, identities)


@query(
    "revocation_cascade",
    with_(
        recipe_sql("sessions", "families", "access_tokens", "session_users"),
        "targets AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'phone_changed' "
        "WHEN user_id % 4 = 1 THEN 'logout_all' ELSE 'no_such_reason' END AS reason "
        "FROM session_users)",
    )
    + """SELECT t.user_id, t.reason,
  (SELECT count(*) FROM families f WHERE f.user_id = t.user_id AND f.revoked_at IS NULL) AS families,
  (SELECT count(*) FROM sessions s WHERE s.user_id = t.user_id AND s.revoked_at IS NULL) AS sessions,
  (SELECT count(*) FROM access_tokens a WHERE a.user_id = t.user_id AND a.revoked_at IS NULL)
    AS tokens
FROM targets t WHERE reason <> 'no_such_reason'""",
)
def revocation_cascade(spark: SparkSession, folder: str) -> DataFrame:
    users, families, sessions, tokens = _sessions(
        spark, folder, "session_users", "families", "sessions", "access_tokens"
    )
    kind = F.col("user_id") % 4
    targets = users.select(
        "user_id",
        F.when(kind == 0, "phone_changed").when(kind == 1, "logout_all")
        .otherwise("no_such_reason").alias("reason"),
    )
    return A.revocation_cascade(targets, families, sessions, tokens)


@query(
    "grant_audit",
    with_(recipe_sql("grants", "grant_challenges"))
    + """SELECT * FROM (SELECT g.grant_id, concat_ws(',',
  CASE WHEN g.uses > 1 THEN 'used_twice' END,
  CASE WHEN g.consumed_at >= g.expires_at THEN 'late' END,
  CASE WHEN g.phone_key <> c.phone_key THEN 'phone' END,
  CASE WHEN g.purpose <> c.purpose THEN 'purpose' END,
  CASE WHEN g.user_id <> c.user_id THEN 'user' END) AS codes
FROM grants g JOIN grant_challenges c ON c.challenge_id = g.challenge_id) WHERE codes <> ''""",
)
def grant_audit(spark: SparkSession, folder: str) -> DataFrame:
    return A.grant_audit(*_sessions(spark, folder, "grants", "grant_challenges"))


QUERIES, ORACLES = registry.queries, registry.oracles
