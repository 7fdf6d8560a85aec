"""Exact replay of an anchored rate limit, without folding a bucket in one task.

A window starts at the first attempt and the next one at the first attempt 15 minutes or more
after that start, so starts form a chain. A pause of a whole window always begins a new one,
which cuts a bucket into islands; only islands longer than a window need the chain, which is
followed by pointer doubling. Inside a window the outcome depends on the first `limit + 1`
attempts and on at most five cooldown starts, each a running minimum in the order of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize
from palimpsest.functions.ordered import previous, running

# The window, the first cooldown, the longest one, and the time slice that
# bounds how many attempts of one bucket a task sees together.
WINDOW_MS = 15 * 60 * 1000
FIRST_COOLDOWN_S = 30
MAX_COOLDOWN_S = 15 * 60
SLICE_MS = 60 * 1000


def cooldown_ms(excess: int) -> int:
    """Cooldown after the attempt that is `excess` above the limit (1, 2, ...)."""
    return min(FIRST_COOLDOWN_S * 2 ** (excess - 1), MAX_COOLDOWN_S) * 1000


def _max_starts() -> int:
    """How many cooldowns can start inside one window."""
    count, used = 1, 0
    while used + cooldown_ms(count) < WINDOW_MS:
        used += cooldown_ms(count)
        count += 1
    return count


def window_starts(times: DataFrame, keys: list[str]) -> DataFrame:
    """Start times of all windows. times: `keys, ts_ms, part`, distinct per key."""
    gaps = previous(times, keys, ["ts_ms"], "part", before=F.col("ts_ms"))
    opens = F.col("before").isNull() | (F.col("ts_ms") - F.col("before") >= WINDOW_MS)
    marked = materialize(
        running(
            gaps.withColumn("opens", opens),
            keys, ["ts_ms"], "part",
            island=("last", F.when(F.col("opens"), F.col("ts_ms"))),
        ).select(*keys, "ts_ms", "part", "opens", "island")
    )
    starts = marked.where("opens").select(*keys, "ts_ms")
    long_islands = (
        marked.groupBy(*keys, "island")
        .agg(F.max("ts_ms").alias("last"))
        .where(F.col("last") - F.col("island") >= WINDOW_MS)
        .select(*keys, "island")
    )
    nodes = marked.join(long_islands, [*keys, "island"], "left_semi")
    inner = [*keys, "island"]
    probe_at = F.col("ts_ms") + WINDOW_MS
    asked = nodes.select(
        *inner, probe_at.alias("at"), F.lit(0).alias("kind"), F.col("ts_ms").alias("origin")
    )
    real = nodes.select(
        *inner, F.col("ts_ms").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("origin"),
    )
    both = asked.unionByName(real).withColumn("part", F.floor(F.col("at") / SLICE_MS))
    found = running(
        both, inner, ["at", "kind"], "part", backwards=True,
        next=("last", F.when(F.col("kind") == 1, F.col("at"))),
    )
    jump = materialize(
        found.where((F.col("kind") == 0) & F.col("next").isNotNull()).select(
            *inner, F.col("origin").alias("ts_ms"), "next"
        )
    )
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        onward = jump.select(*inner, F.col("ts_ms").alias("next"), F.col("next").alias("after"))
        jump = materialize(
            jump.join(onward, [*inner, "next"]).select(
                *inner, "ts_ms", F.col("after").alias("next")
            )
        )
    reached = long_islands.withColumn("ts_ms", F.col("island"))
    for jump in reversed(jumps):
        landed = reached.join(jump, [*inner, "ts_ms"]).select(*inner, F.col("next").alias("ts_ms"))
        reached = materialize(reached.select(*inner, "ts_ms").unionByName(landed).distinct())
    return starts.unionByName(reached.select(*keys, "ts_ms")).distinct()


def rate_limit_replay(attempts: DataFrame, keys: list[str], limit: int | Column) -> DataFrame:
    """Outcome of every attempt: `allowed`, `cooldown_started` or `in_cooldown`.

    attempts: `keys, ts_ms, event_id`. `retry_after_s` is what the caller is told to wait. A limit that is a
    column is one of the keys.
    """
    sliced = attempts.withColumn("part", F.floor(F.col("ts_ms") / SLICE_MS))
    times = sliced.select(*keys, "ts_ms", "part").distinct()
    starts = window_starts(times, keys).withColumn("is_start", F.lit(True))
    placed = running(
        sliced.join(starts, [*keys, "ts_ms"], "left"),
        keys, ["ts_ms", "event_id"], "part",
        window=("last", F.when(F.col("is_start"), F.col("ts_ms"))),
    ).select(*keys, "ts_ms", "event_id", "window")
    # one exchange by window; running minima, each the start of a cooldown once it has been met
    order = Window.partitionBy(*keys, "window").orderBy("ts_ms", "event_id")
    place = F.struct("ts_ms", "event_id")
    due, marks = F.col("n") == limit + 1, []
    placed = placed.withColumn("n", F.row_number().over(order))
    for excess in range(1, _max_starts() + 1):
        name = f"mark_{excess}"
        placed = placed.withColumn(name, F.min(F.when(due, place)).over(order))
        at, until = F.col(name), F.col(name)["ts_ms"] + cooldown_ms(excess)
        marks.append(F.when(at.isNotNull(), F.struct(at.alias("at"), until.alias("until"))))
        due = (F.col("ts_ms") >= until) & (place > at)
    placed = placed.withColumn("last", F.coalesce(*reversed(marks)))
    last = F.col("last")
    outcome = (
        F.when(last.isNull(), "allowed")
        .when(last["at"] == place, "cooldown_started")
        .otherwise("in_cooldown")
    )
    wait = F.greatest(F.ceil((last["until"] - F.col("ts_ms")) / 1000), F.lit(1))
    return placed.select(
        *keys, "event_id", "ts_ms", outcome.alias("outcome"),
        F.when(outcome != "allowed", wait).otherwise(0).cast("long").alias("retry_after_s"),
    )


# Fixed value: what a refused password attempt is told to wait.
REFUSED_S = 30
_BUCKET = ["bucket_type", "bucket_key", "limit"]


def by_bucket(attempts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One row for every bucket of an attempt. limits: bucket type, which names the column of its key -> limit."""
    kinds = [
        F.struct(
            F.lit(kind).alias("bucket_type"), F.col(kind).cast("string").alias("bucket_key"),
            F.lit(limit).cast("long").alias("limit"),
        )
        for kind, limit in limits.items()
    ]
    rest = [c for c in attempts.columns if c not in limits]
    return attempts.select(*rest, F.inline(F.array(*kinds))).where(F.col("bucket_key").isNotNull())


def shared_limit_replay(attempts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Attempts that take a place in all their buckets at once; the longest wait counts.

    attempts: `event_id, ts_ms, purpose` and a key column for every bucket type. A bucket counts an attempt
    whatever the others say, so each is replayed on its own. A null key has no bucket; without any the
    attempt is allowed. `refused_by` names the bucket types that made it wait, in order of their names.
    """
    each = by_bucket(attempts.select("event_id", "ts_ms", "purpose", *limits), limits)
    replayed = rate_limit_replay(each, [*_BUCKET, "purpose"], F.col("limit"))
    waits = replayed.where("retry_after_s > 0").groupBy("event_id").agg(
        F.max("retry_after_s").alias("wait"),
        F.array_join(F.sort_array(F.collect_set("bucket_type")), ",").alias("by"),  # one a type
    )
    return attempts.select("event_id", "ts_ms", "purpose").join(waits, "event_id", "left").select(
        "event_id", "ts_ms", "purpose",
        F.coalesce("wait", F.lit(0)).alias("retry_after_s"), F.coalesce("by", F.lit("")).alias("refused_by"),
    )


def _full_buckets(each: DataFrame, refused: DataFrame) -> DataFrame:
    """`event_id, bucket` of the attempts that meet a full bucket, if exactly `refused` were refused."""
    order, inner = ["ts_ms", "event_id"], [*_BUCKET, "epoch"]
    told = each.join(refused.withColumn("refused", F.lit(True)), "event_id", "left")
    counts = F.col("refused").isNull()
    clears = F.when(counts & F.col("valid"), 1).otherwise(0)
    told = running(told, _BUCKET, order, "part", inclusive=False, epoch=("sum", clears))
    told = materialize(
        told.withColumns({"epoch": F.coalesce("epoch", F.lit(0)), "uses": counts & ~F.col("valid")}).drop("refused")
    )
    times = told.where("uses").select(*inner, "ts_ms", "part").distinct()
    starts = window_starts(times, inner).withColumn("is_start", F.lit(True))
    used = running(told, inner, order, "part", inclusive=False, used=("sum", F.col("uses").cast("long")))
    used = used.withColumn("used", F.coalesce("used", F.lit(0))).join(starts, [*inner, "ts_ms"], "left")
    # of attempts at the time of a start the first one opens the window: the one with the fewest before it
    opens = F.when(F.col("is_start") & F.col("uses"), F.struct("ts_ms", F.negative("used").alias("less")))
    placed = running(used, inner, order, "part", inclusive=False, opened=("max", opens))
    within = F.col("ts_ms") - F.col("opened.ts_ms") < WINDOW_MS
    full = within & (F.col("used") + F.col("opened.less") >= F.col("limit"))
    return placed.where(full).select("event_id", *_BUCKET)


def password_limit_replay(attempts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """`limited`, `failed` or `passed` for every password attempt, whose buckets are coupled.

    attempts: `event_id, ts_ms, valid` (whether phone, user and password are right) and a key column for every
    bucket type. An attempt is limited if any of its buckets is full, and then changes none. Otherwise a wrong
    one takes a place in all of them, and a right one empties them.

    Whether an attempt is limited depends on earlier ones only, so exactly one set of limited attempts agrees with
    itself. It is found by rounds: every bucket is replayed for the set of the round before, until no
    attempt changes. A round settles all attempts whose buckets were settled before them; only buckets of
    attempts that changed are replayed again. Rounds follow the longest chain of attempts that decide each
    other over several buckets, not the number of attempts. Buckets are never gathered: running values and
    window starts are those of the single-bucket replay. A null key has no bucket; a null `valid` is a wrong one.
    """
    attempts = attempts.withColumn("valid", F.coalesce("valid", F.lit(False)))
    each = by_bucket(attempts.select("event_id", "ts_ms", "valid", *limits), limits)
    each = materialize(each.withColumn("part", F.floor(F.col("ts_ms") / SLICE_MS)))
    refused = each.select("event_id").limit(0)
    full, scope = None, each
    while True:
        found = _full_buckets(scope, refused)
        full = materialize(found if full is None else full.join(touched, _BUCKET, "left_anti").unionByName(found))
        now = materialize(full.select("event_id").distinct())
        changed = materialize(
            now.join(refused, "event_id", "left_anti").unionByName(refused.join(now, "event_id", "left_anti"))
        )
        if changed.isEmpty():
            break
        refused = now
        touched = materialize(each.join(changed, "event_id", "left_semi").select(*_BUCKET).distinct())
        scope = each.join(touched, _BUCKET, "left_semi")
    limited = attempts.join(refused.withColumn("refused", F.lit(True)), "event_id", "left")
    outcome = F.when(F.col("refused"), "limited").when(F.col("valid"), "passed").otherwise("failed")
    return limited.select(
        "event_id", "ts_ms", outcome.alias("outcome"),
        F.when(F.col("refused"), REFUSED_S).otherwise(0).cast("long").alias("retry_after_s"),
    )
