"""Cutting lineage with tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(frame: DataFrame) -> DataFrame:
    """Write the rows once and read them back, so that later branches do not recompute them."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def rows_of(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a parquet folder that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


_stages: dict[tuple[str, str, str, int], DataFrame] = {}


def fingerprint(spark: SparkSession, folder: str) -> int:
    """A number that changes with the files below a folder: names, lengths and times, no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    row = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return int(row[0] or 0)


def stage(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """A step several queries of one application share: built on first use, and again when its input changed."""
    key = (spark.sparkContext.applicationId, folder, name, fingerprint(spark, folder))
    if key not in _stages:
        _stages[key] = materialize(build())
    return _stages[key]
