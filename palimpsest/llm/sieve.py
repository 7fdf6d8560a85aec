"""A bit table of ids with a fixed largest size: rows that surely are not among many ids skip a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest table (2 MB); more ids only let more rows through.
MOST_BITS = 1 << 24


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(977)), F.lit(bits))


def sieve(ids: DataFrame, key: str) -> tuple[DataFrame, int]:
    """`word, mask` rows (at most `MOST_BITS / 64`) of the ids, and the number of bits."""
    n = ids.count()
    bits = 1 << 12
    while bits < min(32 * n, MOST_BITS):
        bits *= 2
    place = _place(F.col(key), bits)
    words = ids.select(F.shiftright(place, 6).alias("~word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("~mask"))
    return words.groupBy("~word").agg(F.bit_or("~mask").alias("~mask")), bits


def maybe(frame: DataFrame, key: Column, table: tuple[DataFrame, int], name: str = "~maybe") -> DataFrame:
    """Adds `name`: false only where the key is surely not among the ids (null: false)."""
    words, bits = table
    place = _place(key, bits)
    joined = frame.withColumn("~at", place).join(
        F.broadcast(words.withColumnRenamed("~word", "~of")), F.shiftright(F.col("~at"), 6) == F.col("~of"), "left"
    )
    hit = F.coalesce(F.getbit(F.col("~mask"), (F.col("~at") % 64).cast("int")) == 1, F.lit(False)) & key.isNotNull()
    return joined.withColumn(name, hit).drop("~at", "~of", "~mask")


def without(frame: DataFrame, key: Column, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows of `frame` whose key is not among the ids; only rows that may be are shuffled."""
    marked = maybe(frame, key, sieve(ids, id_column))
    apart = marked.where("not `~maybe`").drop("~maybe")
    asked = marked.where("`~maybe`").drop("~maybe")
    known = ids.select(F.col(id_column).alias("~id"))
    return apart.unionByName(asked.join(known, key == F.col("~id"), "left_anti"))
