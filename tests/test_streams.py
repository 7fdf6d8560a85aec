"""Streams over folders of files, empty folders and several micro-batches."""

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import jobs


def laid_out(frame, path, files, order):
    """The rows in `files` files that arrive in the given order of their keys."""
    frame.orderBy(order).repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)


@pytest.mark.parametrize("files", [1, 3, 7])
@pytest.mark.parametrize("order", ["event_id", "shuffled"])
def test_latest_state_of_a_folder_in_batches(spark, tmp_path, files, order):
    rows = spark.range(200).select(
        F.col("id").alias("event_id"), (F.col("id") % 9).alias("run_id"), F.concat(F.lit("s"), "id").alias("status"),
        F.lit("x").alias("stage"), F.xxhash64("id").alias("shuffled"),
    )
    laid_out(rows, str(tmp_path / "feed.parquet"), files, order)
    feed = jobs.table_stream(spark, str(tmp_path), "feed", files=1)
    updates = jobs.run_to_table(jobs.progress_stream(feed), "update")
    got = {r.run_id: (r.event_id, r.status) for r in jobs.latest_update(updates, "run_id").collect()}
    wanted = {k: max(i for i in range(200) if i % 9 == k) for k in range(9)}
    assert got == {k: (i, f"s{i}") for k, i in wanted.items()}
    assert updates.select("batch_id").distinct().count() == files


def test_an_empty_folder_gives_an_empty_table(spark, tmp_path):
    spark.range(0).select(F.col("id").alias("event_id"), F.lit(1).alias("run_id"), F.lit("s").alias("status"), F.lit("x").alias("stage")).write.parquet(str(tmp_path / "feed.parquet"))
    feed = jobs.table_stream(spark, str(tmp_path), "feed")
    got = jobs.run_to_table(jobs.progress_stream(feed), "update")
    assert got.count() == 0 and "run_id" in got.columns


def test_each_transcript_set_is_merged_once(spark, tmp_path):
    rows = [(1, "the cat"), (1, "the cat"), (2, "a b"), (1, "the cat"), (2, "other words"), (3, "x")]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs.parquet"))
    feed = jobs.table_stream(spark, str(tmp_path), "docs", files=1)

    def variants(batch):
        return batch.select("doc_id", F.col("text").alias("base"), F.concat("text", F.lit("!")).alias("a"), F.col("text").alias("b"))

    found = jobs.reconcile_stream(feed, variants, F.concat_ws("|", F.col("doc_id").cast("string"), "base"))
    got = sorted((r.doc_id, r.preview, r.singletons) for r in found.collect())
    assert got == [(1, "the cat!", 1), (2, "a b!", 1), (2, "other words!", 1), (3, "x!", 1)]


def batches(spark, path, schema, *parts):
    """A stream of one micro-batch for every part, in order."""
    import time

    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by time
    known = spark.read.parquet(path)
    return spark.readStream.schema(known.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_early_events_wait_and_repeated_ones_are_put_aside(spark, tmp_path):
    schema = "phone long, generation long, sequence long, event_type string, to_status string, created_at long"
    ban, block = ("qualifying_ban_applied", None), ("phone_blocked", "blocked")
    feed = batches(spark, str(tmp_path / "log"), schema, [(1, 1, 3, *ban, 30), (1, 1, 1, *ban, 10)], [(1, 1, 4, *block, 40)], [(1, 1, 2, *ban, 20), (1, 1, 1, *ban, 10)])
    rows = jobs.run_to_table(jobs.reputation_stream(feed), "update").collect()
    last = max((r for r in rows if r.outcome == "projected"), key=lambda r: r.batch_id)
    assert (last.sequence, last.ban_count, last.status, last.blocked_at, last.last_ban_at) == (4, 3, "blocked", 40, 30)
    assert [r.sequence for r in rows if r.outcome == "quarantined"] == [1]
    assert sorted((r.batch_id, r.sequence) for r in rows if r.outcome == "held") == [(0, 3), (1, 4)]


def test_an_earlier_reuse_corrects_the_first_report(spark, tmp_path):
    schema = "family_id long, session_id long, used_at long, replaced_at long"
    feed = batches(spark, str(tmp_path / "uses"), schema, [(1, 1, 100, 50)], [(1, 2, 60, 50), (2, 3, 5, None)], [(1, 4, 80, 50)])
    rows = jobs.run_to_table(jobs.reuse_stream(feed), "append").collect()
    assert sorted(r.reused_at for r in rows) == [60, 100]


def test_late_events_are_kept_apart(spark, tmp_path):
    feed = batches(spark, str(tmp_path / "events"), "event_id long, ms long", [(1, 1000), (1, 1000), (2, 5000)], [(2, 5000), (3, 10), (4, 4900)], [(4, 4900), (5, 9000)])
    unique, late = jobs.dedupe_to_table(feed, "event_id", "ms", keep_ms=1000)
    assert sorted(r.event_id for r in unique.collect()) == [1, 2, 4, 5]
    assert [r.event_id for r in late.collect()] == [3]


# restart


class Killed(Exception):
    pass


def progress(spark, path):
    for i in range(4):
        rows = [(10 * i + k, k % 3, f"s{10 * i + k}", "x") for k in range(10)]
        spark.createDataFrame(rows, "event_id long, run_id long, status string, stage string").coalesce(1).write.mode("append").parquet(path)
    known = spark.read.parquet(path)
    return jobs.progress_stream(spark.readStream.schema(known.schema).option("maxFilesPerTrigger", 1).parquet(path))


@pytest.mark.parametrize("moment", ["before rows", "before manifest", "after manifest"])
def test_a_killed_stream_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, moment):
    from palimpsest.streaming import sink

    feed, root, runs = progress(spark, str(tmp_path / "feed")), str(tmp_path / "root"), []
    write, complete = sink.BatchSink.write, sink.BatchSink.complete

    def dying_write(self, batch, batch_id, transform=None):
        runs.append(batch_id)
        if batch_id == 2 and moment == "before rows":
            raise Killed
        write(self, batch, batch_id, transform)
        if batch_id == 2 and moment == "after manifest":
            raise Killed

    def dying_complete(self, batch_id, written):
        if batch_id == 2 and moment == "before manifest":
            raise Killed
        complete(self, batch_id, written)

    monkeypatch.setattr(sink.BatchSink, "write", dying_write)
    monkeypatch.setattr(sink.BatchSink, "complete", dying_complete)
    with pytest.raises(Exception, match="Killed"):
        jobs.run_to_table(feed, "update", root=root)
    assert runs == [0, 1, 2]
    seen = sink.BatchSink(spark, root).manifest()
    assert sorted(r.batch_id for r in seen.collect()) == ([0, 1, 2] if moment == "after manifest" else [0, 1])

    monkeypatch.setattr(sink.BatchSink, "write", write)
    monkeypatch.setattr(sink.BatchSink, "complete", complete)
    again = jobs.run_to_table(feed, "update", root=root)
    whole = jobs.run_to_table(feed, "update", root=str(tmp_path / "other"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
    third = jobs.run_to_table(feed, "update", root=root)  # nothing new: nothing changes
    assert sorted(map(tuple, third.collect())) == sorted(map(tuple, whole.collect()))


def test_rows_of_a_batch_without_manifest_are_not_read(spark, tmp_path):
    from palimpsest.streaming import sink

    kept = sink.BatchSink(spark, str(tmp_path))
    frame = spark.range(3)
    kept.write(frame, 0)
    frame.write.parquet(str(tmp_path / "out/batch_id=1"))
    assert kept.table(frame.schema).count() == 3
    kept.write(spark.range(5), 1)
    kept.write(spark.range(9), 1)  # a complete batch stays as it is
    assert {(r.batch_id, r.rows) for r in kept.manifest().collect()} == {(0, 3), (1, 5)}
    assert kept.table(frame.schema).count() == 8


# state with timers


def replay(attempts, limit):
    """One attempt after the other."""
    from palimpsest.operators import rate_limit as RL

    state, out = {}, {}
    for key, event, now in sorted(attempts, key=lambda a: (a[2], a[1])):
        started, used, until = state.get(key, (None, 0, 0))
        outcome = "allowed"
        if started is None or now - started >= RL.WINDOW_MS:
            started, used, until = now, 1, 0
        elif now < until:
            outcome = "in_cooldown"
        else:
            used, until = used + 1, 0
            if used > limit:
                outcome, until = "cooldown_started", now + RL.cooldown_ms(used - limit)
        state[key], out[event] = (started, used, until), outcome
    return out


def test_attempts_of_any_order_within_the_delay_equal_the_replay(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(4), "login", i, 1_000_000 + rng.randrange(3_000_000)) for i in range(300)]
    rows.sort(key=lambda r: r[3] + rng.randrange(600_000))
    schema = "bucket_key long, purpose string, event_id long, ts_ms long"
    feed = batches(spark, str(tmp_path / "attempts"), schema, rows[:100], rows[100:180], rows[180:])
    root = str(tmp_path / "root")
    opened = jobs.rate_limit_to_table(feed, 3, delay_ms=600_000, root=root, close=False).count()
    assert 0 < opened < len(rows)  # the newest wait for the watermark
    got = jobs.rate_limit_to_table(feed, 3, delay_ms=600_000, root=root).collect()
    assert {r.event_id: r.outcome for r in got} == replay([(r[0], r[2], r[3]) for r in rows], 3) and len(got) == len(rows)


def test_late_attempts_are_told_apart_and_buckets_are_forgotten(spark, tmp_path):
    schema = "bucket_key long, purpose string, event_id long, ts_ms long"
    hour = 3_600_000
    feed = batches(spark, str(tmp_path / "attempts"), schema, [(1, "x", 1, hour), (2, "x", 2, hour)], [(1, "x", 3, 3 * hour)], [(2, "x", 4, 2 * hour), (1, "x", 5, 3 * hour)])
    root = str(tmp_path / "root")
    table = jobs.rate_limit_to_table(feed, 1, root=root)
    assert {r.event_id: r.outcome for r in table.collect()} == {1: "allowed", 2: "allowed", 3: "allowed", 4: "late", 5: "cooldown_started"}
    assert jobs.BatchSink(spark, root).manifest().agg(F.sum("late")).first()[0] == 1
    state = spark.read.format("state-metadata").load(f"{root}/state")
    assert state.count() >= 1
    left = spark.read.format("statestore").option("stateVarName", "window").load(f"{root}/state")
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{root}/state")
    assert left.count() == 0 and waiting.count() == 0


def test_a_large_key_streams_through_its_state(spark, tmp_path):
    n = 5_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("bucket_key"), F.lit("x").alias("purpose"), F.col("id").alias("event_id"), (F.col("id") * 7919 % n * 200).alias("ts_ms"))
    rows.coalesce(1).write.parquet(str(tmp_path / "attempts"))
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "attempts"))
    got = {r.event_id: r.outcome for r in jobs.rate_limit_to_table(feed, 5).collect()}
    assert got == replay([(7, r.event_id, r.ts_ms) for r in rows.collect()], 5)


def test_keys_behind_the_watermark_leave_the_state(spark, tmp_path):
    feed = batches(spark, str(tmp_path / "events"), "event_id long, ms long", [(i, 1000 + i) for i in range(50)], [(99, 9000), (98, None)], [(98, None), (97, 9001)])
    root = str(tmp_path / "root")
    unique, late = jobs.dedupe_to_table(feed, "event_id", "ms", keep_ms=1000, root=root)
    assert unique.count() == 53 and late.count() == 0
    kept = spark.read.format("statestore").option("stateVarName", "newest").load(f"{root}/state")
    assert kept.count() == 3
