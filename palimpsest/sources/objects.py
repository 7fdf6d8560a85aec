"""A content store that knows what it holds: bodies, and a manifest committed after them.

Below the root: `bodies/batch=B/prefix=P` (`content_hash, byte_length, body`) and `manifest/batch=B/prefix=P`
(`content_hash, byte_length`). A write asks the manifest which contents are new, writes their bodies, reads them back,
and lists only those whose bytes fit their hash. Readers see listed bodies only, so what a killed write left is
invisible, is found by the audit as `unlisted`, and is written again by the next write. One writer at a time; if two
ran at once and stored a content twice, readers take the smaller batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.hashing import content_hash
from palimpsest.functions.materialize import rows_of

_PLACE = "batch string, prefix string"
LISTED = f"content_hash string, byte_length long, {_PLACE}"
BODIES = f"content_hash string, byte_length long, body string, {_PLACE}"


class ObjectStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        """`content_hash, byte_length, batch, prefix` of every stored content, once."""
        listed = rows_of(self.spark, f"{self.root}/manifest", LISTED)
        return listed.groupBy("prefix", "content_hash", "byte_length").agg(F.min("batch").alias("batch"))

    def bodies(self) -> DataFrame:
        """All bodies on disk, listed or not, with `intact`: whether hash and length fit the bytes."""
        same = (content_hash(F.col("body")) == F.col("content_hash")) & (F.octet_length("body") == F.col("byte_length"))
        return rows_of(self.spark, f"{self.root}/bodies", BODIES).withColumn("intact", F.coalesce(same, F.lit(False)))

    def read(self) -> DataFrame:
        """Stored contents, each once."""
        keys = ["prefix", "content_hash", "byte_length", "batch"]
        return self.bodies().join(self.manifest(), keys, "left_semi").dropDuplicates(["prefix", "content_hash"])

    def write(self, rows: DataFrame, body: str) -> str:
        """Store every distinct content of a column that is not stored yet; returns the batch. Null is no content.

        Only hashes meet the manifest; contents follow for new hashes. Writing the same rows again stores nothing.
        """
        batch = uuid.uuid4().hex
        hashed = rows.where(F.col(body).isNotNull()).select(
            content_hash(F.col(body)).alias("content_hash"), F.octet_length(body).cast("long").alias("byte_length"),
            F.col(body).alias("body"),
        ).withColumn("prefix", F.substring("content_hash", 8, 2))
        keys = ["prefix", "content_hash"]
        fresh = hashed.select(*keys).distinct().join(self.manifest(), keys, "left_anti")
        # one body a hash: map-side first, so copies of one content do not travel
        once = hashed.join(fresh, keys, "left_semi").dropDuplicates(keys)
        self.write_bodies(once.select("content_hash", "byte_length", "body", "prefix"), batch)
        self.commit(batch)
        return batch

    def write_bodies(self, contents: DataFrame, batch: str) -> None:
        """Ranges of hashes, so that a task writes to few prefixes and a prefix of any size has many tasks."""
        ranged = contents.repartitionByRange("prefix", "content_hash")
        ranged.write.mode("overwrite").partitionBy("prefix").parquet(f"{self.root}/bodies/batch={batch}")

    def commit(self, batch: str) -> None:
        """List a batch's bodies that read back whole; the manifest is written last."""
        whole = self.bodies().where((F.col("batch") == batch) & F.col("intact"))
        listed = whole.select("content_hash", "byte_length", "prefix")
        listed.write.mode("overwrite").partitionBy("prefix").parquet(f"{self.root}/manifest/batch={batch}")

    def audit(self) -> DataFrame:
        """`content_hash, code` of what is wrong with the store itself.

        `unlisted`: a body of no finished write; `lost`: listed without a body; `corrupt`: the bytes do not fit.
        """
        keys = ["prefix", "content_hash", "batch"]
        found = self.bodies().groupBy(*keys).agg(F.bool_or("intact").alias("intact"))
        listed = rows_of(self.spark, f"{self.root}/manifest", LISTED).select(*keys).distinct()
        both = found.join(listed.withColumn("listed", F.lit(True)), keys, "full_outer")
        code = (
            F.when(F.col("listed").isNull(), "unlisted")
            .when(F.col("intact").isNull(), "lost")
            .when(~F.col("intact"), "corrupt")
        )
        return both.select("content_hash", code.alias("code")).where("code IS NOT NULL")

    def check(self, references: DataFrame) -> DataFrame:
        """References (`content_hash, byte_length` and more) with a `code`.

        `no_content` (null hash), `missing` (not stored), `length` (stored with another length) or `ok`.
        """
        stored = self.manifest().select("content_hash", F.col("byte_length").alias("_stored"))
        code = (
            F.when(F.col("content_hash").isNull(), "no_content")
            .when(F.col("_stored").isNull(), "missing")
            .when(F.col("_stored").eqNullSafe(F.col("byte_length")), "ok")
            .otherwise("length")
        )
        return references.join(stored, "content_hash", "left").withColumn("code", code).drop("_stored")
