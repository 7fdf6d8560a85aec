"""Exact places of rows inside their key, without a task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize


def places(frame: DataFrame, key: str, order: Sequence[str], place: str, total: str) -> DataFrame:
    """Adds `place` (from 0, ascending by `order`, nulls first) and `total` (rows of the key).

    Rows are dealt by ranges of (key, order), so a key with a third of all rows spreads over many partitions; each
    partition numbers its own rows, and one small row per key and partition carries the numbers of the earlier ones.
    The numbered rows are written, so a lost task cannot number them anew. `key` must not be null.
    """
    ranged = frame.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    laid = materialize(ranged.withColumn("~at", F.monotonically_increasing_id()))
    laid = laid.withColumn("~part", F.shiftright("~at", 33))
    spans = laid.groupBy(key, "~part").agg(F.min("~at").alias("~from"), F.count("*").alias("~rows"))
    whole = Window.partitionBy(key)
    earlier = whole.orderBy("~part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"~before": F.coalesce(F.sum("~rows").over(earlier), F.lit(0)), total: F.sum("~rows").over(whole)})
    joined = laid.join(spans.drop("~rows"), [key, "~part"])
    return joined.select(*frame.columns, (F.col("~at") - F.col("~from") + F.col("~before")).alias(place), total)
