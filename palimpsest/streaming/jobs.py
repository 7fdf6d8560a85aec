"""Structured Streaming jobs. Each equals its batch twin on the same rows.

Jobs take a `root` folder: started again with the same one, they go on behind their last complete batch (`sink.py`).
Keyed state is kept row by row in the state store (`keyed.py`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.streaming import keyed
from palimpsest.streaming.sink import BatchSink, new_root, run_to_table

#: Event time of a closing row: all that waits for the watermark is due.
END_MS = 32_503_680_000_000

__all__ = [
    "BatchSink", "run_to_table", "table_stream", "progress_stream", "latest_update", "dedupe_to_table", "rate_limit_to_table",
    "reuse_stream", "reputation_stream", "reconcile_stream",
]


def table_stream(spark: SparkSession, folder: str, name: str, *, files: int = 100) -> DataFrame:
    """Files of one table as a stream; `files` bounds the size of a micro-batch.

    A table is one file or a folder of files; a folder may have no files yet.
    """
    path = f"{folder}/{name}.parquet"
    known = spark.read.parquet(path)
    source = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in known.inputFiles()):
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return source.parquet(path)


def progress_stream(events: DataFrame) -> DataFrame:
    """Latest state per run, kept up to date: `run_id, event_id, status, stage`."""
    return events.groupBy("run_id").agg(
        F.max("event_id").alias("event_id"),
        F.max_by("status", "event_id").alias("status"),
        F.max_by("stage", "event_id").alias("stage"),
    )


def latest_update(updates: DataFrame, key: str) -> DataFrame:
    """The newest row per key of an update-mode table."""
    columns = [c for c in updates.columns if c not in (key, "batch_id")]
    return (
        updates.groupBy(key)
        .agg(F.max_by(F.struct(*columns), "batch_id").alias("row"))
        .select(key, *[F.col(f"row.{c}").alias(c) for c in columns])
    )


def _watched(stream: DataFrame, ms: str, delay_ms: int) -> DataFrame:
    """A stream whose rows move the watermark but are not dropped behind it: the job decides on late rows.

    The time column is no column of the rows any more, so the state operator has nothing to compare.
    """
    timed = stream.withColumn("_event_time", F.timestamp_millis(F.greatest(F.col(ms), F.lit(0))))
    return timed.withWatermark("_event_time", f"{delay_ms} milliseconds").drop("_event_time")


def _with(frame: DataFrame, more: str) -> StructType:
    """The columns of a frame and some more."""
    return StructType([*frame.schema.fields, *StructType.fromDDL(more).fields])


def dedupe_to_table(events: DataFrame, key: str, ms: str, keep_ms: int = 30 * 86_400_000, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each key once, and the rows that came too late to tell.

    events: a stream with `key` and event time `ms` (as long). Keys are remembered while they lie less than `keep_ms`
    behind the newest row of earlier batches. Older rows go to the second table, with all their columns, and the
    manifest counts them: they are neither dropped nor mixed with rows known to be new.
    """
    once = keyed.Once(key, events.schema[key].dataType.simpleString(), ms, keep_ms, events.columns)
    sharded = _watched(events, ms, keep_ms).withColumn("shard", keyed.shard([key], keyed.ONCE_SHARDS))
    marked = sharded.groupBy("shard").transformWithState(once, _with(events, "outcome string"), "append", "EventTime")
    rows = run_to_table(marked, "append", root=root)
    return rows.where("outcome = 'unique'").drop("outcome"), rows.where("outcome = 'late'").drop("outcome")


def rate_limit_to_table(attempts: DataFrame, limit: int, *, delay_ms: int = 0, root: str | None = None, close: bool = True) -> DataFrame:
    """The rate limit as keyed state: outcome of every attempt whose time the watermark has passed, and late attempts.

    attempts: `bucket_key, purpose, event_id, ts_ms`, at most `delay_ms` of event time behind the newest of earlier
    batches; others are `late`. `close` ends the stream: it is started once more with a closing row, behind which
    nothing waits. A stream that is to go on is not closed; its newest attempts then wait for the next run.
    """
    spark = attempts.sparkSession
    root = root or new_root(spark)
    columns = ["bucket_key", "purpose", "event_id", "ts_ms"]
    attempts = attempts.select(*columns)
    types = [attempts.schema[c].dataType.simpleString() for c in columns[:2]]
    ends = f"{root}/ends"
    spark.createDataFrame([], attempts.schema).write.mode("append").parquet(ends)
    every = attempts.unionByName(spark.readStream.schema(attempts.schema).parquet(ends))

    def run() -> DataFrame:
        sharded = _watched(every, "ts_ms", delay_ms).withColumn("shard", keyed.shard(columns[:2], keyed.BUCKET_SHARDS))
        outcomes = sharded.groupBy("shard").transformWithState(
            keyed.Bucket(limit, *types), _with(attempts, "outcome string, retry_after_s long"), "append", "EventTime"
        )
        return run_to_table(outcomes, "append", root=root)

    table = run()
    if not close:
        return table
    end = spark.range(1).select(*[F.lit(END_MS if c == "ts_ms" else None).cast(attempts.schema[c].dataType).alias(c) for c in columns])
    end.write.mode("append").parquet(ends)
    return run()


def reuse_stream(uses: DataFrame) -> DataFrame:
    """The first use of an already replaced token per family; the smallest row of a family is the final one.

    uses: `family_id, session_id, used_at, replaced_at`, in any order of arrival.
    """
    # other rows change no family's state
    reuses = uses.where("replaced_at IS NOT NULL AND used_at >= replaced_at")
    return reuses.withColumn("shard", keyed.shard(["family_id"], keyed.REUSE_SHARDS)).groupBy("shard").transformWithState(keyed.FirstReuse(), "family_id long, reused_at long", "append", "None")


def reputation_stream(log: DataFrame) -> DataFrame:
    """Projection per (phone, generation) after each micro-batch.

    Events ahead of a gap are `held` (told once) and applied when it closes; repeated or contradicting ones are `quarantined`.
    """
    schema = (
        "phone long, generation long, sequence long, ban_count long, status string, blocked_at long, last_ban_at long, outcome string"
    )
    sharded = log.withColumn("shard", keyed.shard(["phone", "generation"], keyed.PHONE_SHARDS))
    return sharded.groupBy("shard").transformWithState(keyed.Projection(), schema, "update", "None")


def reconcile_stream(
    documents: DataFrame, variants: Callable[[DataFrame], DataFrame], content_id: Column, root: str | None = None
) -> DataFrame:
    """Reconcile arriving transcript sets, each content once, whatever batch brings it.

    The ids of contents seen are state of the stream, so a batch costs what it brings. Sets are merged row by row,
    so two contents may share a `doc_id`.
    """
    from palimpsest.operators.reconcile import reconcile

    arrived = variants(documents).withColumn("content_id", content_id).dropDuplicates(["content_id"])

    fields = "doc_id long, preview string, conflicts long, singletons long, agreements long"
    schema = documents.sparkSession.createDataFrame([], fields).schema
    return run_to_table(arrived, "append", reconcile, schema, root).drop("batch_id")
