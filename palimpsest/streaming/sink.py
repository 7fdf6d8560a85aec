"""A restartable sink: batches as folders, and a manifest on disk of those that are complete.

A root folder holds all of a stream: `state` (Spark's checkpoint), `out/batch_id=N` (rows) and `manifest/batch_id=N`
(counts, written after the rows). A batch that is in the manifest is never written again, one that is not replaces what a
killed run left of it, and readers see batches of the manifest only. Starting with the same root therefore goes on where
the stream stopped, and replaying a batch changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions.materialize import rows_of, shared_folder

MANIFEST = "rows long, late long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_root(spark: SparkSession) -> str:
    """A folder for a stream that nobody will start again."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


class BatchSink:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def is_complete(self, batch_id: int) -> bool:
        return not rows_of(self.spark, f"{self.root}/manifest/batch_id={batch_id}", MANIFEST).isEmpty()

    def manifest(self) -> DataFrame:
        """`batch_id, rows, late` of every complete batch."""
        return rows_of(self.spark, f"{self.root}/manifest", f"{MANIFEST}, batch_id int")

    def write(self, batch: DataFrame, batch_id: int, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
        if self.is_complete(batch_id):  # replayed: the state store needs the rows, the table does not
            batch.write.format("noop").mode("overwrite").save()
            return
        batch = transform(batch) if transform else batch
        path = f"{self.root}/out/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        self.complete(batch_id, self.spark.read.schema(batch.schema).parquet(path))

    def complete(self, batch_id: int, written: DataFrame) -> None:
        late = F.count_if(F.col("outcome") == "late") if "outcome" in written.columns else F.lit(0).cast("long")
        counts = written.agg(F.count("*").alias("rows"), late.alias("late"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch_id={batch_id}")

    def table(self, schema: StructType) -> DataFrame:
        """Rows of all complete batches, with `batch_id`."""
        named = StructType([*schema.fields]).add("batch_id", "integer")
        rows = rows_of(self.spark, f"{self.root}/out", named)
        return rows.join(F.broadcast(self.manifest().select("batch_id")), "batch_id", "left_semi").select(*named.names)


def run_to_table(
    stream: DataFrame, mode: str, transform: Callable[[DataFrame], DataFrame] | None = None,
    schema: StructType | None = None, root: str | None = None,
) -> DataFrame:
    """Run until the available input is used up; returns the table written so far, with `batch_id`.

    transform: applied to every micro-batch before it is written; `schema` is then that of its rows. With a `root` of an
    earlier run the stream goes on behind its last complete batch. Without any input the result is empty.
    """
    spark = stream.sparkSession
    root = root or new_root(spark)
    sink = BatchSink(spark, root)

    def save(batch: DataFrame, batch_id: int) -> None:
        sink.write(batch, batch_id, transform)

    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True)
            .foreachBatch(save)
            .start()
        )
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    query.awaitTermination()
    return sink.table(schema or stream.schema)
