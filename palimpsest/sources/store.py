"""Content-addressed objects, source registration and the incremental event cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.hashing import content_hash


def new_objects(rows: DataFrame, existing: DataFrame, body: str, owner: str) -> DataFrame:
    """One row per content not stored yet. Hashes are counted map-side before the shuffle."""
    hashed = rows.select(
        content_hash(F.col(body)).alias("content_hash"),
        F.octet_length(body).cast("long").alias("byte_length"),
        F.col(owner),
    )
    unique = hashed.groupBy("content_hash", "byte_length").agg(
        F.min(owner).alias("first_owner"), F.count(F.lit(1)).alias("copies")
    )
    fresh = unique.join(existing.select("content_hash"), "content_hash", "left_anti")
    return fresh.withColumn("prefix", F.substring("content_hash", 8, 2))


def write_objects(rows: DataFrame, body: str, path: str, owner: str, stored: DataFrame | None = None) -> None:
    """Store each distinct content once, in one folder per hash prefix; what `stored` has is not written again.

    Only hashes and owners are shuffled to choose a writer per content; bodies follow for chosen owners.
    """
    if stored is None:
        stored = rows.sparkSession.createDataFrame([], "content_hash string")
    fresh = new_objects(rows, stored, body, owner)
    chosen = fresh.select("content_hash", F.col("first_owner").alias(owner), "prefix", "byte_length")
    hashed = rows.select(owner, content_hash(F.col(body)).alias("content_hash"), F.col(body).alias("body"))
    picked = hashed.join(chosen, ["content_hash", owner]).drop(owner)
    once = picked.dropDuplicates(["content_hash"]).select("content_hash", "body", "byte_length", "prefix")
    once.write.mode("append").partitionBy("prefix").parquet(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects with `intact`: whether hash and length still fit the bytes read."""
    stored = spark.read.parquet(path)
    same = (content_hash(F.col("body")) == F.col("content_hash")) & (F.octet_length("body") == F.col("byte_length"))
    return stored.withColumn("intact", same)


def normal_path(path: Column) -> Column:
    """Absolute path without empty, `.` and `..` steps."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.expr("cast(array() as array<string>)")

    def walk(done: Column, step: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(step == "..", up).otherwise(F.array_append(done, step))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, empty, walk), "/"))


def register_sources(rows: DataFrame) -> DataFrame:
    """One source per (run, normal path): the first registration wins."""
    return (
        rows.withColumn("locator", normal_path(F.col("path")))
        .groupBy("run_id", "locator")
        .agg(
            F.min("registered").alias("registered"),
            F.min_by("source_id", "registered").alias("source_id"),
            F.count(F.lit(1)).alias("requests"),
        )
    )


def after_cursor(events: DataFrame, key: str, cursor: int) -> DataFrame:
    """Events behind a cursor, in order; the filter reaches the parquet scan."""
    return events.where(F.col(key) > cursor).orderBy(key)
