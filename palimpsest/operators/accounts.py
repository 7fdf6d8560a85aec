"""Sessions, identities, grants and challenges as batch jobs over account tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.chains import chain_roots

# Lifetimes and limits.
FAMILY_TTL_MS = 180 * 24 * 60 * 60 * 1000
MAX_FAMILIES = 5
CHALLENGE_ATTEMPTS = 5
REVOCATION_REASONS = (
    "user_request", "refresh_token_reuse", "user_suspended", "session_limit_eviction",
    "administrative_revoke", "logout_all", "password_changed", "password_reset", "phone_changed",
)


def session_is_active(now: int) -> Column:
    """All seven conditions; expiries are half-open and an unknown phone state is not normal."""
    return F.coalesce(
        F.col("revoked_at").isNull()
        & F.col("replaced_by").isNull()
        & (F.lit(now) < F.col("expires_at"))
        & F.col("family_revoked_at").isNull()
        & (F.lit(now) < F.col("family_created_at") + FAMILY_TTL_MS)
        & (F.col("user_status") == "active")
        & (F.col("phone_status") == "normal"),
        F.lit(False),
    )


def with_state(sessions: DataFrame, families: DataFrame, users: DataFrame) -> DataFrame:
    family = families.select(
        "family_id",
        F.col("revoked_at").alias("family_revoked_at"),
        F.col("created_at").alias("family_created_at"),
    )
    return sessions.join(family, "family_id").join(users, "user_id")


def active_sessions(
    sessions: DataFrame, families: DataFrame, users: DataFrame, tokens: DataFrame, now: int
) -> DataFrame:
    """Valid sessions, with how many of their access tokens are valid themselves."""
    live = tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    counts = live.groupBy("session_id").agg(F.count(F.lit(1)).alias("live_tokens"))
    valid = with_state(sessions, families, users).where(session_is_active(now))
    return valid.join(counts, "session_id", "left").select(
        "session_id", "user_id", "family_id", F.coalesce("live_tokens", F.lit(0)).alias("live_tokens")
    )


def evicted_families(families: DataFrame, sessions: DataFrame, now: int) -> DataFrame:
    """Families to revoke before a user's next login: all but the newest four active ones.

    The rank filter keeps at most four rows per user and map task before the shuffle.
    """
    leaf = sessions.where(
        F.col("revoked_at").isNull() & F.col("replaced_by").isNull() & (F.col("expires_at") > now)
    )
    active = families.where(
        F.col("revoked_at").isNull() & (F.col("created_at") + FAMILY_TTL_MS > now)
    ).join(leaf, "family_id", "left_semi")
    newest = Window.partitionBy("user_id").orderBy(
        F.col("created_at").desc(), F.col("family_id").desc()
    )
    kept = active.withColumn("n", F.row_number().over(newest)).where(
        F.col("n") <= MAX_FAMILIES - 1
    )
    return active.join(kept.select("family_id"), "family_id", "left_anti").select(
        "user_id", "family_id", "created_at"
    )


def refresh_reuse(sessions: DataFrame, uses: DataFrame, tokens: DataFrame) -> DataFrame:
    """Families revoked because a replaced token was presented again, and what falls with them."""
    reused = uses.join(
        sessions.where(F.col("replaced_by").isNotNull()), "session_id"
    ).where(F.col("used_at") >= F.col("revoked_at"))
    first = reused.groupBy("family_id").agg(F.min("used_at").alias("reused_at"))
    hit = sessions.join(first, "family_id").where(F.col("created_at") <= F.col("reused_at"))
    open_tokens = tokens.where(F.col("revoked_at").isNull()).select(
        "session_id", F.col("created_at").alias("token_created_at")
    )
    token_counts = (
        hit.select("session_id", "family_id", "reused_at")
        .join(open_tokens, "session_id")
        .where(F.col("token_created_at") <= F.col("reused_at"))
        .groupBy("family_id")
        .agg(F.count(F.lit(1)).alias("tokens_revoked"))
    )
    open_then = F.col("revoked_at").isNull() | (F.col("revoked_at") > F.col("reused_at"))
    counts = hit.groupBy("family_id", "reused_at").agg(
        F.count_if(open_then).alias("sessions_revoked")
    )
    return counts.join(token_counts, "family_id", "left").select(
        "family_id", "reused_at", "sessions_revoked",
        F.coalesce("tokens_revoked", F.lit(0)).alias("tokens_revoked"),
    )


def rotation_chains(sessions: DataFrame) -> DataFrame:
    """First and last session of each family's rotation, and whether one live leaf remains."""
    replacements = sessions.where(F.col("replaced_by").isNotNull()).select(
        F.col("replaced_by").alias("session_id"), F.lit(True).alias("follows")
    )
    marked = sessions.join(replacements.dropDuplicates(["session_id"]), "session_id", "left")
    root, leaf = F.col("follows").isNull(), F.col("replaced_by").isNull()
    live = leaf & F.col("revoked_at").isNull()
    return marked.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(root).alias("roots"),
        F.min(F.when(root, F.col("session_id"))).alias("root_id"),
        F.max(F.when(leaf, F.col("session_id"))).alias("leaf_id"),
        F.count_if(live).alias("live_leaves"),
    ).withColumn("sound", (F.col("roots") == 1) & (F.col("live_leaves") <= 1))


def identity_uniqueness(
    users: DataFrame, identities: DataFrame, credentials: DataFrame
) -> DataFrame:
    """Subjects active twice, and users without exactly one active phone and one password."""
    active = identities.where(F.col("status") == "active")
    shared = (
        active.groupBy("provider", "subject")
        .agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") > 1)
        .select(F.concat_ws(":", "provider", "subject").alias("owner"),
                F.lit("subject_active_twice").alias("code"), "found")
    )
    phones = (
        active.where(F.col("provider") == "phone")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("phones"))
    )
    passwords = credentials.groupBy("user_id").agg(F.count(F.lit(1)).alias("passwords"))
    counted = users.join(phones, "user_id", "left").join(passwords, "user_id", "left")
    owner = F.col("user_id").cast("string").alias("owner")
    found = {c: F.coalesce(F.col(c), F.lit(0)).alias("found") for c in ("phones", "passwords")}
    wrong_phone = counted.where(F.coalesce("phones", F.lit(0)) != 1).select(
        owner, F.lit("active_phones").alias("code"), found["phones"]
    )
    wrong_password = counted.where(F.coalesce("passwords", F.lit(0)) != 1).select(
        owner, F.lit("passwords").alias("code"), found["passwords"]
    )
    return shared.unionByName(wrong_phone).unionByName(wrong_password)


def erasure_plan(erased: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows to delete and to keep per owned table when the given users are erased."""
    marks = erased.select("user_id").distinct().withColumn("gone", F.lit(True))
    plan = None
    for name, rows in tables.items():
        counted = (
            rows.join(marks, "user_id", "left")
            .agg(
                F.count_if(F.col("gone")).alias("rows_to_delete"),
                F.count_if(F.col("gone").isNull()).alias("rows_kept"),
            )
            .select(F.lit(name).alias("table_name"), "rows_to_delete", "rows_kept")
        )
        plan = counted if plan is None else plan.unionByName(counted)
    return plan


def expiry_purge(tables: dict[str, DataFrame], now: int) -> DataFrame:
    purge = None
    for name, rows in tables.items():
        counted = rows.agg(F.count_if(F.col("expires_at") <= now).alias("expired")).select(
            F.lit(name).alias("table_name"), "expired"
        )
        purge = counted if purge is None else purge.unionByName(counted)
    return purge


def audit_trail(events: DataFrame) -> DataFrame:
    return events.orderBy("user_id", "occurred_at", "event_id")


def _active_phones(identities: DataFrame) -> DataFrame:
    return identities.where((F.col("provider") == "phone") & (F.col("status") == "active"))


def eligible_users(users: DataFrame, identities: DataFrame, credentials: DataFrame) -> DataFrame:
    """Active users with a password and a phone in normal standing."""
    password = credentials.select("user_id", F.lit(True).alias("has_password"))
    phone = _active_phones(identities).select("user_id", "subject", "phone_status")
    joined = users.join(password, "user_id", "left").join(phone, "user_id", "left")
    return joined.where(
        (F.col("status") == "active")
        & F.col("has_password").isNotNull()
        & (F.col("phone_status") == "normal")
    ).select("user_id", "subject")


def erasure_eligible(users: DataFrame, identities: DataFrame, bans: DataFrame) -> DataFrame:
    """Suspended users with an effective ban and an active phone."""
    return (
        users.where(F.col("status") == "suspended")
        .join(bans.where(F.col("overturned_at").isNull()), "user_id")
        .join(_active_phones(identities).select("user_id", "subject"), "user_id")
        .select("user_id", "ban_id", "subject")
    )


def identity_lookup(identities: DataFrame) -> DataFrame:
    """Every identity with the one that replaced it in the end, ordered per user."""
    chains = chain_roots(
        identities.select(F.col("identity_id").alias("id"), F.col("replaced_by").alias("parent"))
    )
    return (
        identities.join(chains, F.col("identity_id") == F.col("id"))
        .select(
            "user_id", "identity_id", "provider", "subject", "status",
            F.col("root").alias("current_identity_id"), F.col("depth").alias("replacements"),
        )
        .orderBy("user_id", "identity_id")
    )


def find_identity(identities: DataFrame, asked: DataFrame) -> DataFrame:
    """The active identity of each asked `provider, subject`, if there is one."""
    active = identities.where(F.col("status") == "active").select("provider", "subject", "identity_id", "user_id")
    return asked.select("provider", "subject").distinct().join(active, ["provider", "subject"], "left")


def revocation_cascade(
    targets: DataFrame, families: DataFrame, sessions: DataFrame, tokens: DataFrame
) -> DataFrame:
    """Revoked counts per user: families, then their sessions, then the access tokens.

    targets: `user_id, reason`; a reason outside the finite set revokes nothing.
    """
    real = targets.where(F.col("reason").isin(*REVOCATION_REASONS))
    counted = real.select("user_id", "reason")
    for name, rows in (("families", families), ("sessions", sessions), ("tokens", tokens)):
        open_rows = (
            rows.where(F.col("revoked_at").isNull())
            .join(real, "user_id", "left_semi")
            .groupBy("user_id")
            .agg(F.count(F.lit(1)).alias(name))
        )
        counted = counted.join(open_rows, "user_id", "left")
    return counted.select(
        "user_id", "reason",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("families", "sessions", "tokens")],
    )


def grant_audit(grants: DataFrame, challenges: DataFrame) -> DataFrame:
    """Codes of grants used twice, late, or bound to another phone, purpose or user."""
    bound = challenges.select(
        "challenge_id",
        F.col("user_id").alias("c_user"),
        F.col("phone_key").alias("c_phone"),
        F.col("purpose").alias("c_purpose"),
    )
    joined = grants.join(bound, "challenge_id", "left")
    rules = (
        ("no_challenge", F.col("c_phone").isNull()),
        ("used_twice", F.col("uses") > 1),
        ("late", F.col("consumed_at") >= F.col("expires_at")),
        ("phone", F.col("phone_key") != F.col("c_phone")),
        ("purpose", F.col("purpose") != F.col("c_purpose")),
        ("user", F.col("user_id") != F.col("c_user")),
    )
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    return joined.select("grant_id", F.array_join(codes, ",").alias("codes")).where(
        F.col("codes") != ""
    )


def challenge_replay(challenges: DataFrame, attempts: DataFrame) -> DataFrame:
    """Final state of each code challenge.

    challenges: `challenge_id, expires_at, phone, purpose`; attempts: `challenge_id, event_id, ts_ms, correct,
    phone, purpose`. In order of time, an attempt before the expiry verifies a challenge that is still `sent`
    if code, phone and purpose fit; any other takes one of the attempts left, also from a verified one, and
    the last one makes it fail for good. An attempt at or after the expiry expires it whatever it was. After
    `2 * CHALLENGE_ATTEMPTS + 1` attempts none is left, so no later one is gathered.
    """
    bound = challenges.select("challenge_id", "expires_at", F.col("phone").alias("c_phone"), F.col("purpose").alias("c_purpose"))
    timed = attempts.join(bound, "challenge_id")
    fits = F.col("correct") & F.col("phone").eqNullSafe(F.col("c_phone")) & F.col("purpose").eqNullSafe(F.col("c_purpose"))
    order = Window.partitionBy("challenge_id").orderBy("ts_ms", "event_id")
    first = (
        timed.where(F.col("ts_ms") < F.col("expires_at"))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= 2 * CHALLENGE_ATTEMPTS + 1)
        .groupBy("challenge_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "ts_ms", fits.alias("fits")))).alias("steps"))
    )
    late = timed.where(F.col("ts_ms") >= F.col("expires_at")).select("challenge_id").distinct()
    nothing = F.lit(None).cast("long")

    def state(status: Column, left: Column, verified: Column) -> Column:
        return F.struct(status.alias("status"), left.alias("left"), verified.alias("verified_at"))

    def step(held: Column, attempt: Column) -> Column:
        left = F.greatest(held["left"] - 1, F.lit(0))
        failed = state(F.when(left == 0, "failed").otherwise("sent"), left, held["verified_at"])
        passed = state(F.lit("verified"), held["left"], attempt["ts_ms"])
        return F.when((held["status"] == "sent") & attempt["fits"], passed).otherwise(failed)

    start = state(F.lit("sent"), F.lit(CHALLENGE_ATTEMPTS), nothing)
    joined = challenges.join(first, "challenge_id", "left").join(late.withColumn("late", F.lit(True)), "challenge_id", "left")
    held = joined.withColumn("held", F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, step)))
    return held.select(
        "challenge_id",
        F.when(F.col("late"), "expired").otherwise(F.col("held.status")).alias("status"),
        F.col("held.left").cast("long").alias("attempts_remaining"),
        F.col("held.verified_at").alias("verified_at"),
    )
