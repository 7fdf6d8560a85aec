"""Phone reputation ledgers: replaying commands into events, and events into projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import length_prefixed
from palimpsest.functions.ordered import previous, running

# Bans that block a phone, and the ids per slice that windows work on.
BAN_THRESHOLD = 3
WIDTH = 1 << 20


def _sliced(frame: DataFrame, column: str) -> DataFrame:
    return frame.withColumn("part", F.floor(F.col(column) / WIDTH))


def generation_resets(requests: DataFrame, holders: DataFrame) -> DataFrame:
    """Reassignments start the next generation, unless an active identity holds the phone.

    requests: `phone, event_id`; holders: `phone`. Generations count from 1.
    """
    held = holders.select("phone").distinct().withColumn("held", F.lit(True))
    marked = requests.join(held, "phone", "left").withColumn(
        "accepted", F.when(F.col("held").isNull(), 1).otherwise(0)
    )
    counted = running(
        _sliced(marked, "event_id"), ["phone"], ["event_id"], "part",
        resets=("sum", F.col("accepted")),
    )
    return counted.select(
        "phone",
        "event_id",
        F.when(F.col("accepted") == 1, "generation_started").otherwise("refused").alias("outcome"),
        (F.col("resets") + 1).alias("generation"),
    )


def with_generation(commands: DataFrame, resets: DataFrame) -> DataFrame:
    """Add the generation in force at each command (`phone, event_id, ...`)."""
    accepted = resets.where(F.col("outcome") == "generation_started").select(
        "phone", "event_id", F.lit(1).alias("starts")
    )
    joined = commands.join(accepted, ["phone", "event_id"], "left")
    return running(
        _sliced(joined, "event_id"), ["phone"], ["event_id"], "part",
        seen=("sum", F.coalesce("starts", F.lit(0))),
    ).withColumn("generation", F.col("seen") + 1).drop("part", "seen", "starts")


def effective_bans(commands: DataFrame) -> DataFrame:
    """The first ban of each account on a phone; later ones of the same account do nothing."""
    bans = commands.where(F.col("kind") == "ban")
    first = bans.groupBy("phone", "account").agg(F.min("event_id").alias("event_id"))
    return bans.join(first.select("phone", "event_id"), ["phone", "event_id"], "left_semi")


def ban_outcomes(commands: DataFrame) -> DataFrame:
    """Status changes: which ban blocks its phone and which unblock frees it.

    A ban blocks when the generation's count reaches the threshold while the phone is normal;
    an unblock keeps the count, so the next ban blocks again. Output rows are bans with their
    count, and unblocks with a NULL count; `changes` tells whether the status changed.
    """
    counted = running(
        _sliced(effective_bans(commands), "event_id"),
        ["phone", "generation"], ["event_id"], "part",
        ban_count=("sum", F.lit(1)),
    ).drop("part")
    unblocks = commands.where(F.col("kind") == "unblock").withColumn(
        "ban_count", F.lit(None).cast("long")
    )
    both = counted.unionByName(unblocks)
    strong = F.when(F.col("kind") == "unblock", "unblock").when(
        F.col("ban_count") >= BAN_THRESHOLD, "ban"
    )
    relevant = both.withColumn("strong", strong).where(F.col("strong").isNotNull())
    chained = previous(
        _sliced(relevant, "event_id"), ["phone", "generation"], ["event_id"], "part",
        before=F.col("strong"),
    )
    was_blocked = F.coalesce(F.col("before") == "ban", F.lit(False))
    changed = chained.where((F.col("strong") == "ban") != was_blocked).select(
        "phone", "event_id", F.lit(True).alias("changes")
    )
    return both.join(changed, ["phone", "event_id"], "left").select(
        "phone", "generation", "event_id", "ts_ms", "kind", "ban_count",
        F.coalesce("changes", F.lit(False)).alias("changes"),
    )


def ban_overturns(overturns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Effect of overturning bans, once each, in the generation of the ban.

    overturns: `phone, generation` (current), `event_id, ts_ms, target_id`. The phone is freed
    only when its latest status change is the block that this very ban caused and the
    generation is still current.
    """
    bans = outcomes.where(F.col("kind") == "ban").select(
        "phone", F.col("event_id").alias("target_id"), F.col("generation").alias("ban_generation")
    )
    first = overturns.groupBy("phone", "target_id").agg(F.min("event_id").alias("first_id"))
    known = overturns.join(bans, ["phone", "target_id"], "left").join(
        first, ["phone", "target_id"], "left"
    )
    changes = outcomes.where("changes").select(
        "phone", "generation", "event_id",
        F.struct("kind", F.col("event_id").alias("cause")).alias("status"),
    )
    asked = known.select(
        "phone", "generation", "event_id", F.lit(None).cast(changes.schema["status"].dataType).alias("status")
    )
    latest = running(
        _sliced(changes.unionByName(asked), "event_id"),
        ["phone", "generation"], ["event_id"], "part",
        now=("last", F.col("status")),
    ).where(F.col("status").isNull()).select("phone", "event_id", "now")
    joined = known.join(latest, ["phone", "event_id"])
    outcome = (
        F.when(F.col("ban_generation").isNull(), "unknown_ban")
        .when(F.col("event_id") != F.col("first_id"), "already_overturned")
        .otherwise("overturned")
    )
    frees = (
        (outcome == "overturned")
        & (F.col("ban_generation") == F.col("generation"))
        & (F.col("now.kind") == "ban")
        & (F.col("now.cause") == F.col("target_id"))
    )
    return joined.select(
        "phone", "event_id", "ts_ms", "target_id",
        F.col("ban_generation").alias("generation"),
        outcome.alias("outcome"),
        F.coalesce(frees, F.lit(False)).alias("unblocks"),
    )


LEDGER = (
    "phone", "generation", "command_id", "event_id", "created_at", "stream", "event_type",
    "delta", "target_id", "from_status", "to_status",
)


def ledger(commands: DataFrame, outcomes: DataFrame, overturns: DataFrame) -> DataFrame:
    """The event log with a contiguous sequence per (phone, generation)."""

    def rows(frame, slot, stream, kind, delta=None, target=None, before=None, after=None):
        return frame.select(
            "phone",
            "generation",
            F.col("event_id").alias("command_id"),
            (F.col("event_id") * 10 + slot).alias("event_id"),
            F.col("ts_ms").alias("created_at"),
            F.lit(stream).alias("stream"),
            F.lit(kind).alias("event_type"),
            F.lit(delta).cast("long").alias("delta"),
            (F.lit(None) if target is None else target).cast("long").alias("target_id"),
            F.lit(before).cast("string").alias("from_status"),
            F.lit(after).cast("string").alias("to_status"),
        )

    starts = commands.groupBy("phone", "generation").agg(
        F.min("event_id").alias("event_id"), F.min("ts_ms").alias("ts_ms")
    )
    bans = outcomes.where(F.col("kind") == "ban")
    unblocks = outcomes.where((F.col("kind") == "unblock") & F.col("changes"))
    done = overturns.where(F.col("outcome") == "overturned")
    target = F.col("target_id") * 10 + 2
    parts = [
        rows(starts, 0, "status", "generation_started", after="normal"),
        rows(starts, 1, "sanction", "generation_started", 0),
        rows(bans, 2, "sanction", "qualifying_ban_applied", 1),
        rows(bans.where("changes"), 3, "status", "phone_blocked", before="normal", after="blocked"),
        rows(unblocks, 4, "status", "phone_unblocked", before="blocked", after="normal"),
        rows(done, 5, "sanction", "qualifying_ban_overturned", -1, target),
        rows(done.where("unblocks"), 6, "status", "phone_unblocked", None, target, "blocked", "normal"),
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return running(
        _sliced(log, "command_id"), ["phone", "generation"], ["event_id"], "part",
        sequence=("sum", F.lit(1)),
    ).select(*LEDGER, "sequence")


def replay(log: DataFrame) -> DataFrame:
    """Projection per (phone, generation) from the two event streams; no window is needed.

    Of events with one sequence number the one of the larger `event_id` counts, as in `audit`.
    """
    changes = F.col("event_type").isin("phone_blocked", "phone_unblocked")
    place = F.struct("sequence", "event_id") if "event_id" in log.columns else F.col("sequence")
    last = F.max_by(F.struct("to_status", "created_at"), F.when(changes, place))
    ban = F.col("event_type") == "qualifying_ban_applied"
    folded = log.groupBy("phone", "generation").agg(
        F.coalesce(F.sum("delta"), F.lit(0)).alias("ban_count"),
        last.alias("last"),
        F.max_by(F.when(ban, F.col("created_at")), F.when(ban, place)).alias("last_ban_at"),
    )
    status = F.coalesce("last.to_status", F.lit("normal"))
    return folded.select(
        "phone", "generation", "ban_count", status.alias("status"),
        F.when(status == "blocked", F.col("last.created_at")).alias("blocked_at"),
        "last_ban_at",
    )


def audit(log: DataFrame, projections: DataFrame) -> DataFrame:
    """Violations as `phone, generation, code, found`.

    projections: `phone, current_generation, ban_count, status, blocked_at, last_ban_at`.
    A log row without `event_type` is a head whose detail is missing.
    """
    keys = ["phone", "generation"]
    kind, seq = F.col("event_type"), F.col("sequence")
    walked = running(
        _sliced(log, "sequence"), keys, ["sequence", "event_id"], "part",
        inclusive=False, count_before=("sum", F.col("delta")), status_before=("last", F.col("to_status")),
    )
    moves = kind.isin("phone_blocked", "phone_unblocked")
    count = F.coalesce("count_before", F.lit(0)) + F.coalesce("delta", F.lit(0))
    start = kind == "generation_started"
    rules = {
        "missing_detail": kind.isNull(),
        "start_order": start & (seq != F.when(F.col("stream") == "status", 1).otherwise(2)),
        "negative_count": (F.col("stream") == "sanction") & (count < 0),
        "from_status": moves
        & (F.col("from_status") != F.coalesce("status_before", F.lit("normal"))),
    }
    counted = walked.groupBy(*keys).agg(
        *[F.count_if(rule).alias(code) for code, rule in rules.items()],
        F.count(F.lit(1)).alias("n"),
        F.min("sequence").alias("low"),
        F.max("sequence").alias("high"),
    )
    doubled = (
        log.groupBy(*keys, "sequence")
        .agg(F.count(F.lit(1)).alias("uses"))
        .groupBy(*keys)
        .agg(F.count_if(F.col("uses") > 1).alias("doubled"))
    )
    shaped = counted.join(doubled, keys)
    gap = (F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("doubled") > 0)
    pairs = F.array(
        *[F.struct(F.lit(code).alias("code"), F.col(code).alias("found")) for code in rules],
        F.struct(F.lit("sequence_gap").alias("code"), F.when(gap, 1).otherwise(0).cast("long").alias("found")),
    )
    found = shaped.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.code", "p.found")
    overturns = log.where(kind == "qualifying_ban_overturned")
    first = overturns.groupBy("target_id").agg(F.min("sequence").alias("first_seq"))
    bans = log.where(kind == "qualifying_ban_applied").select(
        F.col("event_id").alias("target_id"), F.col("generation").alias("g"), F.col("sequence").alias("s")
    )
    checked = overturns.join(bans, "target_id", "left").join(first, "target_id", "left")
    wrong = (
        F.col("g").isNull()
        | (F.col("g") != F.col("generation"))
        | (F.col("s") >= seq)
        | (seq > F.col("first_seq"))
    )
    bad_overturn = checked.groupBy(*keys).agg(F.count_if(wrong).alias("found")).select(
        *keys, F.lit("bad_overturn").alias("code"), "found"
    )
    rebuilt = replay(log.where(kind.isNotNull()))
    stored = projections.select(
        "phone", "current_generation",
        *[F.col(c).alias(f"p_{c}") for c in ("ban_count", "status", "blocked_at", "last_ban_at")],
    )
    joined = rebuilt.join(stored, "phone", "left")
    same = F.lit(True)
    for c in ("ban_count", "status", "blocked_at", "last_ban_at"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    current = F.col("generation") == F.col("current_generation")
    state = F.array(
        F.struct(
            F.lit("projection").alias("code"),
            F.when(current & ~same, 1).otherwise(0).cast("long").alias("found"),
        ),
        F.struct(
            F.lit("future_generation").alias("code"),
            F.when(F.col("generation") > F.col("current_generation"), 1).otherwise(0).cast("long").alias("found"),
        ),
    )
    states = joined.select(*keys, F.explode(state).alias("p")).select(*keys, "p.code", "p.found")
    return found.unionByName(bad_overturn).unionByName(states).where(F.col("found") > 0)


def operation_completeness(log: DataFrame, operations: DataFrame) -> DataFrame:
    """Operations whose event counts or actors disagree with the log, and orphan events.

    operations: `operation_id, expected_sanction, expected_status, op_actor, op_generation`; the log
    carries `command_id` and `actor`.
    """
    seen = log.groupBy(F.col("command_id").alias("operation_id")).agg(
        F.count_if(F.col("stream") == "sanction").alias("sanctions"),
        F.count_if(F.col("stream") == "status").alias("statuses"),
        F.min("actor").alias("a1"),
        F.max("actor").alias("a2"),
        F.min("generation").alias("g1"),
        F.max("generation").alias("g2"),
    )
    both = operations.join(seen, "operation_id", "full_outer")
    known = F.col("expected_sanction").isNotNull()
    incomplete = (F.col("expected_sanction") != F.coalesce("sanctions", F.lit(0))) | (
        F.col("expected_status") != F.coalesce("statuses", F.lit(0))
    )
    differs = (
        (F.col("a1") != F.col("op_actor"))
        | (F.col("a2") != F.col("op_actor"))
        | (F.col("g1") != F.col("op_generation"))
        | (F.col("g2") != F.col("op_generation"))
    )
    codes = F.array_compact(
        F.array(
            F.when(~known, "orphan_events"),
            F.when(known & incomplete, "incomplete"),
            F.when(known & differs, "disagrees"),
        )
    )
    return both.select("operation_id", F.array_join(codes, ",").alias("codes")).where(
        F.col("codes") != ""
    )


def operation_dedupe(requests: DataFrame, fields: list[str]) -> DataFrame:
    """First request of an operation id applies; equal content replays, other content conflicts."""
    print_ = F.sha2(length_prefixed(F.lit("operation-v1"), *[F.col(c) for c in fields]), 256)
    hashed = requests.withColumn("fingerprint", print_)
    first = hashed.groupBy("operation_id").agg(
        F.min("event_id").alias("first_id"), F.min_by("fingerprint", "event_id").alias("first_print")
    )
    outcome = (
        F.when(F.col("event_id") == F.col("first_id"), "applied")
        .when(F.col("fingerprint") == F.col("first_print"), "replay")
        .otherwise("conflict")
    )
    return hashed.join(first, "operation_id").select(
        "operation_id", "event_id", "fingerprint", outcome.alias("outcome")
    )
