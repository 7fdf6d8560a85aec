import random

from palimpsest.operators import rate_limit
from palimpsest.operators.rate_limit import (
    WINDOW_MS,
    cooldown_ms,
    password_limit_replay,
    rate_limit_replay,
    shared_limit_replay,
)

LIMITS = {"phone": 3, "client": 4, "ip": 6}


def replay(attempts, limit):
    """One bucket at a time, one attempt at a time."""
    out, state = {}, {}
    for bucket, ts, event in sorted(attempts):
        started, used, until = state.get(bucket, (None, 0, 0))
        if started is None or ts - started >= WINDOW_MS:
            started, used, until, result = ts, 1, 0, ("allowed", 0)
        elif ts < until:
            result = ("in_cooldown", max(1, -(-(until - ts) // 1000)))
        else:
            used += 1
            if used > limit:
                until = ts + cooldown_ms(used - limit)
                result = ("cooldown_started", cooldown_ms(used - limit) // 1000)
            else:
                until, result = 0, ("allowed", 0)
        state[bucket] = (started, used, until)
        out[event] = result
    return out


def test_dense_hot_bucket_and_sparse_buckets(spark):
    rng = random.Random(3)
    rows, event = [], 0
    clock = 1_000_000
    for _ in range(900):  # one bucket, two hours without a pause, some equal times
        clock += rng.choice([0, 50, 4_000, 9_000, 20_000])
        rows.append((1, clock, event))
        event += 1
    for bucket in range(2, 12):
        clock = rng.randint(0, 2_000_000)
        for _ in range(25):
            clock += rng.choice([1_000, 60_000, WINDOW_MS - 1, WINDOW_MS, 2 * WINDOW_MS])
            rows.append((bucket, clock, event))
            event += 1
    frame = spark.createDataFrame(rows, "bucket long, ts_ms long, event_id long")
    got = {
        r.event_id: (r.outcome, r.retry_after_s)
        for r in rate_limit_replay(frame, ["bucket"], 5).collect()
    }
    assert got == replay(rows, 5)


def test_five_attempts_pass_and_the_sixth_waits(spark):
    rows = [(1, 1000 * i, i) for i in range(7)]
    frame = spark.createDataFrame(rows, "bucket long, ts_ms long, event_id long")
    got = [r.outcome for r in rate_limit_replay(frame, ["bucket"], 5).orderBy("event_id").collect()]
    assert got == ["allowed"] * 5 + ["cooldown_started", "in_cooldown"]


def shared_log(rng, n):
    """Attempts of few phones, devices and addresses, with bursts, pauses, equal times and missing keys."""
    rows, clock = [], 0
    for event in range(n):
        clock += rng.choice([0, 0, 1_000, 20_000, 40_000, 90_000, WINDOW_MS // 3])
        keys = [rng.randint(1, 4), rng.randint(1, 5), rng.choice([1, 1, 1, 2, None])]
        rows.append((event, clock, rng.choice(["login", "change"]), rng.choice([False, False, False, True, None]), *keys))
    return rows


SCHEMA = "event_id long, ts_ms long, purpose string, valid boolean, phone long, client long, ip long"


def test_places_in_all_buckets_at_once(spark):
    rows = shared_log(random.Random(5), 250)
    wanted = {r[0]: 0 for r in rows}
    for kind, key in (("phone", 4), ("client", 5), ("ip", 6)):
        own = replay([((r[key], r[2]), r[1], r[0]) for r in rows if r[key] is not None], LIMITS[kind])
        for event, (_, wait) in own.items():
            wanted[event] = max(wanted[event], wait)
    got = shared_limit_replay(spark.createDataFrame(rows, SCHEMA), LIMITS).collect()
    assert {r.event_id: r.retry_after_s for r in got} == wanted and len(got) == len(rows)
    assert all(bool(r.refused_by) == (r.retry_after_s > 0) for r in got)


def plain_passwords(rows):
    state, out = {}, {}
    for event, ts, _, valid, *keys in sorted(rows, key=lambda r: (r[1], r[0])):
        buckets = [(k, v) for k, v in zip(LIMITS, keys, strict=True) if v is not None]
        live = [b for b in buckets if b in state and ts - state[b][0] < WINDOW_MS]
        if any(state[b][1] >= LIMITS[b[0]] for b in live):
            out[event] = "limited"
        elif valid:
            out[event] = "passed"
            for b in buckets:
                state.pop(b, None)
        else:
            out[event] = "failed"
            for b in buckets:
                state[b] = (state[b][0], state[b][1] + 1) if b in live else (ts, 1)
    return out


def test_password_attempts_check_all_buckets_before_they_count(spark):
    rows = shared_log(random.Random(11), 45)
    rows += [(1000 + i, 400_000 + 7 * i, "login", None, None, None, None) for i in range(3)]
    wanted = plain_passwords(rows)
    got = password_limit_replay(spark.createDataFrame(rows, SCHEMA), LIMITS).collect()
    assert {r.event_id: r.outcome for r in got} == wanted and len(got) == len(rows)
    assert set(wanted.values()) == {"limited", "passed", "failed"}
    assert {r.retry_after_s for r in got if r.outcome == "limited"} == {30}
    assert password_limit_replay(spark.createDataFrame([], SCHEMA), LIMITS).count() == 0


def test_cooldowns_of_a_window_are_found_in_one_pass(spark, monkeypatch):
    """No join or written stage for each cooldown: only window starts are written."""
    written, real = [], rate_limit.materialize
    monkeypatch.setattr(rate_limit, "materialize", lambda frame: written.append(1) or real(frame))
    rows = [("a", 1_000 * 13 * i, i) for i in range(65)] + [("b", 5, 100), ("b", 5, 101), ("b", 5, 102)]
    found = rate_limit_replay(spark.createDataFrame(rows, "bucket string, ts_ms long, event_id long"), ["bucket"], 2)
    wanted = replay(rows, 2)
    assert {r.event_id: (r.outcome, r.retry_after_s) for r in found.collect()} == {e: tuple(x) for e, x in wanted.items()}
    assert len(written) <= 2
