"""Reading the given tables. Explicit columns only, so the parquet scan stays narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wall_ms(ts: Column) -> Column:
    """Epoch milliseconds of a zone-free timestamp, whatever the session time zone is."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000
    clock = F.hour(ts).cast("long") * 3_600_000 + F.minute(ts).cast("long") * 60_000
    return day + clock + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")
