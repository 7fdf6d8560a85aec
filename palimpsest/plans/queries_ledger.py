"""Registered reputation ledger, privacy and identity-rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.materialize import stage
from palimpsest.operators import privacy as X
from palimpsest.operators import reputation as P
from palimpsest.operators import validation as V
from palimpsest.plans.recipes import EV_SQL, events
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import table

registry = Registry()
query = registry.query


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


COMMANDS_SQL = f"""{EV_SQL},
cmd0 AS (SELECT user_id AS phone, event_id, ms AS ts_ms, event_id % 500 AS account,
  CASE WHEN event_type = 'error' THEN 'ban' WHEN event_type = 'signup' THEN 'unblock'
    WHEN event_type = 'purchase' AND event_id % 25 = 0 THEN 'reassign'
    WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'overturn' ELSE 'other' END AS kind FROM ev),
resets AS (SELECT phone, event_id,
    CASE WHEN phone % 3 <> 0 THEN 'generation_started' ELSE 'refused' END AS outcome,
    CAST(1 + sum(CASE WHEN phone % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY phone
      ORDER BY event_id) AS BIGINT) AS generation FROM cmd0 WHERE kind = 'reassign'),
commands AS (SELECT *, CAST(1 + sum(CASE WHEN kind = 'reassign' AND phone % 3 <> 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY phone ORDER BY event_id) AS BIGINT) AS generation FROM cmd0)"""
OUTCOMES_SQL = """eff AS (SELECT *, count(*) OVER (PARTITION BY phone, generation ORDER BY event_id)
    AS ban_count FROM commands WHERE kind = 'ban' QUALIFY row_number() OVER (
    PARTITION BY phone, account ORDER BY event_id) = 1),
eff2 AS (SELECT phone, generation, event_id, ts_ms, kind, row_number() OVER (
    PARTITION BY phone, generation ORDER BY event_id) AS ban_count FROM eff),
both_ AS (SELECT * FROM eff2 UNION ALL SELECT phone, generation, event_id, ts_ms, kind, NULL
    FROM commands WHERE kind = 'unblock'),
rel AS (SELECT phone, event_id, kind, lag(kind) OVER (PARTITION BY phone, generation
    ORDER BY event_id) AS prior FROM both_ WHERE kind = 'unblock' OR ban_count >= 3),
outcomes AS (SELECT b.*, coalesce((r.kind = 'ban') <> coalesce(r.prior = 'ban', false), false)
    AS changes FROM both_ b LEFT JOIN rel r ON r.phone = b.phone AND r.event_id = b.event_id)"""
OVERTURNS_SQL = """ot0 AS (SELECT phone, generation, event_id, ts_ms, target_id FROM (
    SELECT *, last_value(CASE WHEN is_ban THEN event_id END IGNORE NULLS) OVER (PARTITION BY phone
      ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS target_id
    FROM (SELECT phone, generation, event_id, ts_ms, kind, false AS is_ban FROM commands
            WHERE kind = 'overturn'
          UNION ALL SELECT phone, generation, event_id, ts_ms, kind, true FROM eff2))
  WHERE kind = 'overturn' AND target_id IS NOT NULL),
st AS (SELECT phone, generation, event_id, last_value(s IGNORE NULLS) OVER (
    PARTITION BY phone, generation ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS now, asks
  FROM (SELECT phone, generation, event_id, {'kind': kind, 'cause': event_id} AS s, false AS asks
        FROM outcomes WHERE changes
        UNION ALL SELECT phone, generation, event_id, NULL, true FROM ot0)),
ot1 AS (SELECT o.*, b.generation AS ban_generation, min(o.event_id) OVER (
    PARTITION BY o.phone, o.target_id) AS first_id, s.now
  FROM ot0 o LEFT JOIN eff2 b ON b.phone = o.phone AND b.event_id = o.target_id
  JOIN st s ON s.asks AND s.phone = o.phone AND s.event_id = o.event_id),
overturns AS (SELECT phone, event_id, ts_ms, target_id, ban_generation AS generation,
    CASE WHEN event_id <> first_id THEN 'already_overturned' ELSE 'overturned' END AS outcome,
    coalesce(event_id = first_id AND ban_generation = generation AND now.kind = 'ban'
      AND now.cause = target_id, false) AS unblocks FROM ot1)"""


def _row(source, slot, stream, kind, delta="NULL", target="NULL", before="NULL", after="NULL"):
    return (
        f"SELECT phone, generation, event_id AS command_id, event_id * 10 + {slot} AS event_id, "
        f"ts_ms AS created_at, '{stream}' AS stream, '{kind}' AS event_type, "
        f"CAST({delta} AS BIGINT) AS delta, CAST({target} AS BIGINT) AS target_id, "
        f"CAST({before} AS VARCHAR) AS from_status, CAST({after} AS VARCHAR) AS to_status "
        f"FROM {source}"
    )


LEDGER_SQL = (
    "starts AS (SELECT phone, generation, min(event_id) AS event_id, min(ts_ms) AS ts_ms "
    "FROM commands GROUP BY phone, generation),\nledger AS (SELECT *, row_number() OVER ("
    "PARTITION BY phone, generation ORDER BY event_id) AS sequence FROM ("
    + " UNION ALL ".join(
        [
            _row("starts", 0, "status", "generation_started", after="'normal'"),
            _row("starts", 1, "sanction", "generation_started", "0"),
            _row("eff2", 2, "sanction", "qualifying_ban_applied", "1"),
            _row("outcomes WHERE kind = 'ban' AND changes", 3, "status", "phone_blocked",
                 before="'normal'", after="'blocked'"),
            _row("outcomes WHERE kind = 'unblock' AND changes", 4, "status", "phone_unblocked",
                 before="'blocked'", after="'normal'"),
            _row("overturns WHERE outcome = 'overturned'", 5, "sanction",
                 "qualifying_ban_overturned", "-1", "target_id * 10 + 2"),
            _row("overturns WHERE unblocks", 6, "status", "phone_unblocked",
                 target="target_id * 10 + 2", before="'blocked'", after="'normal'"),
        ]
    )
    + "))"
)


def replay_sql(out: str, log: str) -> str:
    return f"""{out} AS (SELECT phone, generation, ban_count, coalesce(st.s, 'normal') AS status,
  CASE WHEN st.s = 'blocked' THEN st.t END AS blocked_at, last_ban_at FROM (
  SELECT phone, generation, CAST(coalesce(sum(delta), 0) AS BIGINT) AS ban_count,
    arg_max({{'s': to_status, 't': created_at}}, sequence)
      FILTER (event_type IN ('phone_blocked', 'phone_unblocked')) AS st,
    arg_max(created_at, sequence) FILTER (event_type = 'qualifying_ban_applied') AS last_ban_at
  FROM {log} GROUP BY phone, generation))"""


_ALL = (COMMANDS_SQL, OUTCOMES_SQL, OVERTURNS_SQL, LEDGER_SQL)


def commands(spark: SparkSession, folder: str) -> DataFrame:
    def build():
        e = F.col("event_id")
        kind = (
            F.when(F.col("event_type") == "error", "ban")
            .when(F.col("event_type") == "signup", "unblock")
            .when((F.col("event_type") == "purchase") & (e % 25 == 0), "reassign")
            .when((F.col("event_type") == "click") & (e % 4 == 0), "overturn")
            .otherwise("other")
        )
        rows = events(spark, folder).select(
            F.col("user_id").alias("phone"), "event_id", F.col("ms").alias("ts_ms"),
            (e % 500).alias("account"), kind.alias("kind"),
        )
        return P.with_generation(rows, _resets(rows))

    return stage(spark, folder, "commands", build)


def _resets(rows: DataFrame) -> DataFrame:
    holders = rows.where(F.col("phone") % 3 == 0).select("phone")
    return P.generation_resets(
        rows.where(F.col("kind") == "reassign").select("phone", "event_id"), holders
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "ban_outcomes", lambda: P.ban_outcomes(commands(spark, folder))
    )


def overturns(spark: SparkSession, folder: str) -> DataFrame:
    from palimpsest.functions.ordered import running

    def build():
        rows, done = commands(spark, folder), outcomes(spark, folder)
        bans = done.where(F.col("kind") == "ban").select(
            "phone", "generation", "event_id", "ts_ms", F.lit("ban").alias("kind")
        )
        asks = rows.where(F.col("kind") == "overturn").select(
            "phone", "generation", "event_id", "ts_ms", "kind"
        )
        placed = running(
            bans.unionByName(asks).withColumn("part", F.floor(F.col("event_id") / P.WIDTH)),
            ["phone"], ["event_id"], "part",
            target_id=("last", F.when(F.col("kind") == "ban", F.col("event_id"))),
        )
        targeted = placed.where(
            (F.col("kind") == "overturn") & F.col("target_id").isNotNull()
        ).drop("part", "kind")
        return P.ban_overturns(targeted, done)

    return stage(spark, folder, "overturns", build)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "ledger",
        lambda: P.ledger(
            commands(spark, folder), outcomes(spark, folder), overturns(spark, folder)
        ),
    )


@query(
    "generation_reset",
    with_(COMMANDS_SQL) + "SELECT phone, event_id, outcome, generation FROM resets",
)
def generation_reset(spark: SparkSession, folder: str) -> DataFrame:
    return _resets(commands(spark, folder))


@query(
    "ban_threshold",
    with_(COMMANDS_SQL, OUTCOMES_SQL)
    + "SELECT phone, generation, event_id, ts_ms, kind, ban_count, changes FROM outcomes",
)
def ban_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes(spark, folder)


@query(
    "ban_overturn",
    with_(COMMANDS_SQL, OUTCOMES_SQL, OVERTURNS_SQL)
    + "SELECT phone, event_id, ts_ms, target_id, generation, outcome, unblocks FROM overturns",
)
def ban_overturn(spark: SparkSession, folder: str) -> DataFrame:
    return overturns(spark, folder)


@query(
    "reputation_replay",
    with_(*_ALL, replay_sql("projection", "ledger")) + "SELECT * FROM projection",
)
def reputation_replay(spark: SparkSession, folder: str) -> DataFrame:
    return P.replay(ledger(spark, folder))


_FAULTY_SQL = """log AS (SELECT phone, generation, command_id, event_id, created_at, stream,
  CASE WHEN gone THEN NULL ELSE event_type END AS event_type,
  CASE WHEN gone THEN NULL ELSE delta END AS delta, target_id, from_status, to_status,
  CASE WHEN command_id % 223 = 0 THEN sequence + 1 ELSE sequence END AS sequence
  FROM (SELECT *, command_id % 211 = 0 AND event_id % 10 = 2 AS gone FROM ledger)),
stored AS (SELECT p.phone, CASE WHEN p.phone % 19 = 0 THEN m.g - 1 ELSE m.g END AS current_generation,
  CASE WHEN p.phone % 17 = 0 THEN ban_count + 1 ELSE ban_count END AS ban_count, status, blocked_at,
  last_ban_at FROM projection p JOIN (SELECT phone, max(generation) AS g FROM ledger GROUP BY phone) m
  ON m.phone = p.phone AND m.g = p.generation)"""
_AUDIT_SQL = """walk AS (SELECT *, coalesce(sum(delta) OVER w, 0) AS count_now,
    last_value(to_status IGNORE NULLS) OVER (PARTITION BY phone, generation
      ORDER BY sequence, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM log WINDOW w AS (PARTITION BY phone, generation ORDER BY sequence, event_id
    ROWS UNBOUNDED PRECEDING)),
ov AS (SELECT o.*, b.generation AS g, b.sequence AS s, min(o.sequence) OVER (
    PARTITION BY o.target_id) AS first_seq FROM log o
  LEFT JOIN log b ON b.event_id = o.target_id AND b.event_type = 'qualifying_ban_applied'
  WHERE o.event_type = 'qualifying_ban_overturned'),
codes AS (
  SELECT phone, generation, 'missing_detail' AS code, count(*) FILTER (event_type IS NULL) AS found
  FROM walk GROUP BY phone, generation
  UNION ALL SELECT phone, generation, 'start_order', count(*) FILTER (
    event_type = 'generation_started' AND sequence <> CASE stream WHEN 'status' THEN 1 ELSE 2 END)
  FROM walk GROUP BY phone, generation
  UNION ALL SELECT phone, generation, 'negative_count', count(*) FILTER (
    stream = 'sanction' AND count_now < 0) FROM walk GROUP BY phone, generation
  UNION ALL SELECT phone, generation, 'from_status', count(*) FILTER (
    event_type IN ('phone_blocked', 'phone_unblocked') AND from_status <> coalesce(prior, 'normal'))
  FROM walk GROUP BY phone, generation
  UNION ALL SELECT phone, generation, 'sequence_gap', CASE WHEN min(sequence) <> 1
    OR max(sequence) <> count(*) OR count(DISTINCT sequence) <> count(*) THEN 1 ELSE 0 END
  FROM walk GROUP BY phone, generation
  UNION ALL SELECT phone, generation, 'bad_overturn', count(*) FILTER (g IS NULL
    OR g <> generation OR s >= sequence OR sequence > first_seq) FROM ov GROUP BY phone, generation
  UNION ALL SELECT r.phone, r.generation, 'projection', CASE WHEN r.generation = s.current_generation
    AND (r.ban_count IS DISTINCT FROM s.ban_count OR r.status IS DISTINCT FROM s.status
      OR r.blocked_at IS DISTINCT FROM s.blocked_at OR r.last_ban_at IS DISTINCT FROM s.last_ban_at)
    THEN 1 ELSE 0 END FROM rebuilt r LEFT JOIN stored s ON s.phone = r.phone
  UNION ALL SELECT r.phone, r.generation, 'future_generation',
    CASE WHEN r.generation > s.current_generation THEN 1 ELSE 0 END
  FROM rebuilt r LEFT JOIN stored s ON s.phone = r.phone)"""


@query(
    "reputation_audit",
    with_(
        *_ALL,
        replay_sql("projection", "ledger"),
        _FAULTY_SQL,
        replay_sql("rebuilt", "(SELECT * FROM log WHERE event_type IS NOT NULL)"),
        _AUDIT_SQL,
    )
    + "SELECT phone, generation, code, CAST(found AS BIGINT) AS found FROM codes WHERE found > 0",
)
def reputation_audit(spark: SparkSession, folder: str) -> DataFrame:
    log = ledger(spark, folder)
    gone = (F.col("command_id") % 211 == 0) & (F.col("event_id") % 10 == 2)
    broken = log.withColumns(
        {
            "event_type": F.when(~gone, F.col("event_type")),
            "delta": F.when(~gone, F.col("delta")),
            "sequence": F.when(F.col("command_id") % 223 == 0, F.col("sequence") + 1).otherwise(
                F.col("sequence")
            ),
        }
    )
    newest = log.groupBy("phone").agg(F.max("generation").alias("generation"))
    stored = (
        P.replay(log)
        .join(newest, ["phone", "generation"])
        .select(
            "phone",
            F.when(F.col("phone") % 19 == 0, F.col("generation") - 1)
            .otherwise(F.col("generation"))
            .alias("current_generation"),
            F.when(F.col("phone") % 17 == 0, F.col("ban_count") + 1)
            .otherwise(F.col("ban_count"))
            .alias("ban_count"),
            "status", "blocked_at", "last_ban_at",
        )
    )
    return P.audit(broken, stored)


@query(
    "operation_completeness",
    with_(
        *_ALL,
        """ops AS (SELECT command_id, count(*) FILTER (stream = 'sanction') AS s,
  count(*) FILTER (stream = 'status') AS t FROM ledger GROUP BY command_id)""",
    )
    + """SELECT * FROM (SELECT command_id AS operation_id, CASE WHEN command_id % 103 = 0
  THEN 'orphan_events' ELSE concat_ws(',', CASE WHEN command_id % 97 = 0 THEN 'incomplete' END,
  CASE WHEN command_id % 101 = 0 THEN 'disagrees' END) END AS codes FROM ops) WHERE codes <> ''""",
)
def operation_completeness(spark: SparkSession, folder: str) -> DataFrame:
    log = ledger(spark, folder).withColumn("actor", F.lit("admin"))
    e = F.col("operation_id")
    operations = (
        log.groupBy(F.col("command_id").alias("operation_id"))
        .agg(
            F.count_if(F.col("stream") == "sanction").alias("s"),
            F.count_if(F.col("stream") == "status").alias("t"),
            F.min("generation").alias("op_generation"),
        )
        .where(e % 103 != 0)
        .select(
            "operation_id",
            F.when(e % 97 == 0, F.col("s") + 1).otherwise(F.col("s")).alias("expected_sanction"),
            F.col("t").alias("expected_status"),
            "op_generation",
            F.when(e % 101 == 0, "service").otherwise("admin").alias("op_actor"),
        )
    )
    return P.operation_completeness(log, operations)


_OP = "event_id // 3"
_BE = "unhex(printf('%08x', strlen({0}))) || encode({0})"


@query(
    "operation_dedupe",
    f"""WITH r AS (SELECT event_id, {_OP} AS operation_id, sha256({_BE.format("'operation-v1'")} ||
    {_BE.format('f1')} || {_BE.format('f2')}) AS fingerprint FROM (SELECT event_id,
    'phone_' || ({_OP}) % 50 AS f1, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE 'ban' END AS f2
    FROM events))
SELECT operation_id, event_id, fingerprint, CASE WHEN event_id = first_value(event_id) OVER w
  THEN 'applied' WHEN fingerprint = first_value(fingerprint) OVER w THEN 'replay' ELSE 'conflict'
  END AS outcome FROM r WINDOW w AS (PARTITION BY operation_id ORDER BY event_id)""",
)
def operation_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    op = F.floor(F.col("event_id") / 3)
    requests = table(spark, folder, "events").select(
        "event_id",
        op.alias("operation_id"),
        F.concat(F.lit("phone_"), (op % 50).cast("string")).alias("f1"),
        F.when(F.col("event_id") % 7 == 0, "other").otherwise("ban").alias("f2"),
    )
    return P.operation_dedupe(requests, ["f1", "f2"])


# Keys for derived test data only.
KEY_1 = bytes(range(32))
KEY_2 = bytes(range(32, 64))
AES_KEY = bytes(range(64, 96))
PURPOSE = "phone-lookup-v1"


def _phones(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("+86"), F.lpad(F.col("c_custkey").cast("string"), 11, "0")).alias("phone"),
    )


_PHONE_SQL = "('+86' || lpad(CAST(c_custkey AS VARCHAR), 11, '0'))"


def hmac_sql(key: bytes, text: str) -> str:
    block = key.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in block).hex()
    outer = bytes(b ^ 0x5C for b in block).hex()
    message = f"{_BE.format(repr(PURPOSE))} || {_BE.format(text)}"
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


@query(
    "pseudonymize",
    f"SELECT c_custkey AS user_id, 'key_1' AS key_id, {hmac_sql(KEY_1, _PHONE_SQL)} AS lookup "
    "FROM customer",
)
def pseudonymize(spark: SparkSession, folder: str) -> DataFrame:
    return _phones(spark, folder).select(
        "user_id", F.lit("key_1").alias("key_id"),
        F.lower(F.hex(X.lookup_key(KEY_1, PURPOSE, F.col("phone")))).alias("lookup"),
    )


@query(
    "key_rotation_lookup",
    f"""SELECT {_PHONE_SQL} AS phone, m AS matches, CASE WHEN m = 0 THEN NULL ELSE c_custkey END
  AS reputation_id, CASE m WHEN 0 THEN 'absent' WHEN 1 THEN 'found' ELSE 'duplicate' END AS outcome
FROM (SELECT c_custkey, CASE WHEN c_custkey % 37 = 0 THEN 0 WHEN c_custkey % 29 = 0 THEN 2 ELSE 1
      END AS m FROM customer)
UNION ALL SELECT 'unknown_keys', count(*), NULL, 'key_9' FROM customer WHERE c_custkey % 37 = 0""",
)
def key_rotation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    phones = _phones(spark, folder)
    n = F.col("user_id")
    under = (
        F.when(n % 37 == 0, F.array(F.lit("key_9")))
        .when(n % 29 == 0, F.array(F.lit("key_1"), F.lit("key_2")))
        .when(n % 2 == 0, F.array(F.lit("key_1")))
        .otherwise(F.array(F.lit("key_2")))
    )
    digest = F.when(
        F.col("key_id") == "key_1", X.lookup_key(KEY_1, PURPOSE, F.col("phone"))
    ).otherwise(X.lookup_key(KEY_2, PURPOSE, F.col("phone")))
    stored = phones.select(n.alias("reputation_id"), "phone", F.explode(under).alias("key_id"))
    stored = stored.withColumn("digest", digest)
    found = X.find_by_any_key(phones, stored, {"key_1": KEY_1, "key_2": KEY_2}, PURPOSE)
    strange = X.unknown_keys(stored, ["key_1", "key_2"]).select(
        F.lit("unknown_keys").alias("phone"), F.col("rows").alias("matches"),
        F.lit(None).cast("long").alias("reputation_id"), F.col("key_id").alias("outcome"),
    )
    return found.unionByName(strange)


@query(
    "encrypt_column",
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 41 = 0 THEN 'unreadable'
  WHEN c_custkey % 43 = 0 THEN 'key_mismatch' ELSE 'ok' END AS outcome FROM customer""",
)
def encrypt_column(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("user_id")
    rows = _phones(spark, folder).withColumn(
        "digest",
        F.when(n % 43 == 0, X.lookup_key(KEY_2, PURPOSE, F.col("phone"))).otherwise(
            X.lookup_key(KEY_1, PURPOSE, F.col("phone"))
        ),
    )
    # a per-row IV keeps the check repeatable; without one the library draws a random IV
    iv = F.unhex(F.substring(F.sha2(n.cast("string"), 256), 1, 24))
    sealed = X.encrypt_column(rows, "phone", "user_id", AES_KEY, iv=iv)
    moved = sealed.withColumn("user_id", n).withColumn(
        "cipher",
        F.when(
            n % 41 == 0, F.concat(F.substring("cipher", 1, 20), F.unhex(F.lit("00" * 24)))
        ).otherwise(F.col("cipher")),
    )
    return X.decrypt_audit(moved, "user_id", AES_KEY, KEY_1, PURPOSE)


# RE2 has no look-behind, so the oracle keeps the character before the name instead.
_CREDENTIAL_SQL = (
    rf"(?i)(^|[^\p{{L}}\p{{N}}_-])((?:{X.NAMES})[\"']?\s*[:=]\s*){X.VALUES}".replace("'", "''")
)
_TAIL = (
    ' X-Api-Key: abc; Authorization: Bearer def {"tos_secret_key": "ghi"} '
    "echo fixture-secret/+1 fixture-secret%2F%2B1 X-Tt-Logid=trace-1"
)


@query(
    "redact_secrets",
    f"""SELECT doc_id, c AS body, substr(c, 1, 4096) AS excerpt, length(c) > 4096 AS excerpt_cut
FROM (SELECT doc_id, regexp_replace(replace(replace('{_TAIL}' || text || '{_TAIL}',
    'fixture-secret%2F%2B1', '[REDACTED]'), 'fixture-secret/+1', '[REDACTED]'),
  '{_CREDENTIAL_SQL}', '\\1\\2[REDACTED]', 'g') AS c FROM documents)""",
)
def redact_secrets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit(_TAIL), "text", F.lit(_TAIL)).alias("message")
    )
    return X.redact(rows, "message", ["fixture-secret/+1"])


@query(
    "phone_format",
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 97 = 0 THEN '0' || c_custkey
  WHEN c_custkey % 89 = 0 THEN '+86' || c_custkey || chr(10) ELSE '+86' || c_custkey END AS phone,
  c_custkey % 97 <> 0 AND c_custkey % 89 <> 0 AS canonical FROM customer""",
)
def phone_format(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("c_custkey")
    phone = (
        F.when(n % 97 == 0, F.concat(F.lit("0"), n.cast("string")))
        .when(n % 89 == 0, F.concat(F.lit("+86"), n.cast("string"), F.lit("\n")))
        .otherwise(F.concat(F.lit("+86"), n.cast("string")))
    )
    rows = table(spark, folder, "customer").select(n.alias("user_id"), phone.alias("phone"))
    return rows.withColumn("canonical", V.is_phone(F.col("phone")))


@query(
    "identity_claim_audit",
    """SELECT c_custkey AS user_id, concat_ws(',',
  CASE WHEN c_custkey % 5 = 4 THEN 'provider' END,
  CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'subject' END,
  CASE WHEN c_custkey % 5 = 0 AND (c_custkey % 7 = 0 OR c_custkey % 11 = 0) THEN 'phone' END,
  CASE WHEN c_custkey % 13 = 0 THEN 'digest' END) AS codes FROM customer""",
)
def identity_claim_audit(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("c_custkey")
    good = F.concat(F.lit("+86"), n.cast("string"))
    digest = F.concat(F.lit("hmac-sha256:key_1:"), F.sha2(n.cast("string"), 256))
    rows = table(spark, folder, "customer").select(
        n.alias("user_id"),
        F.when(n % 5 == 0, "phone").when(n % 5 == 1, "email").when(n % 5 == 2, "qq")
        .when(n % 5 == 3, "apple").otherwise("fax").alias("provider"),
        F.when(n % 7 == 0, "").when(n % 11 == 0, F.concat(good, F.lit("\u00a0"))).otherwise(good)
        .alias("subject"),
        F.when(n % 13 == 0, F.upper(digest)).otherwise(digest).alias("digest"),
    )
    return V.identity_claim_audit(rows).select("user_id", "codes")


@query(
    "blocklist_filter",
    "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 50 <> 0",
)
def blocklist_filter(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("c_custkey")
    words = spark.createDataFrame(
        [("123456789012345",), ("passwordpassword",), ("qwertyuiop12345",)], "value string"
    )
    rows = table(spark, folder, "customer").select(
        n.alias("user_id"),
        F.when(n % 100 == 0, "PasswordPassword").when(n % 50 == 0, "QWERTYuiop12345")
        .otherwise(F.col("c_name")).alias("password"),
    )
    return X.blocklist_filter(rows, "password", words).select("user_id")


QUERIES, ORACLES = registry.queries, registry.oracles
