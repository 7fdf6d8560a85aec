"""Batch calls of a user function over a request table, with intents and attempts in a ledger folder.

A request that succeeded is never sent again, one whose delivery is unclear is never replayed, and only a completed but
invalid response is retried, once, with the same idempotency key.

The folder is the caller's and outlives a run. Intents are written to it before any call, attempts as each partition
ends (its task commits its own files). A run that is killed leaves intents without attempts; the next run with the same
folder closes them as `delivery_ambiguous` and calls only what has no intent. A task that is tried again within a run
may follow one that has called already, so it calls nothing and its requests become ambiguous as well. Turn speculation
off: a speculative copy of a task is a first try.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize, rows_of, shared_folder

INTENT = "idempotency_key string, prompt string, attempt int"
ATTEMPT = "idempotency_key string, attempt int, status string, response string"
ANSWER = "idempotency_key string, attempt int, response string, delivery string"


def pending_requests(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    closed = ledger.where(F.col("status").isin("succeeded", "delivery_ambiguous"))
    return requests.join(closed.select("idempotency_key"), "idempotency_key", "left_anti")


def _call(function: Callable[[pd.DataFrame], pd.DataFrame]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = TaskContext.get().attemptNumber() > 0
        for batch in batches:
            answers = batch.assign(response=None, delivery="ambiguous") if again else function(batch)
            yield answers[["idempotency_key", "attempt", "response", "delivery"]]

    return run


class Ledger:
    """Intents and attempts below one folder, one subfolder for every round of calls."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def intents(self) -> DataFrame:
        return rows_of(self.spark, f"{self.root}/intents", INTENT).select("idempotency_key", "prompt", "attempt")

    def attempts(self) -> DataFrame:
        return rows_of(self.spark, f"{self.root}/attempts", ATTEMPT).select("idempotency_key", "attempt", "status", "response")

    def _append(self, rows: DataFrame, name: str) -> None:
        # version 2 of the committer moves the files of a task when the task ends, not when all have
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.root}/attempts/round={name}")

    def recover(self) -> None:
        """Close the intents of killed runs."""
        open_ = self.intents().join(self.attempts(), ["idempotency_key", "attempt"], "left_anti")
        if not open_.isEmpty():
            lost = open_.select("idempotency_key", "attempt", F.lit("delivery_ambiguous").alias("status"), F.lit(None).cast("string").alias("response"))
            self._append(materialize(lost), uuid.uuid4().hex)

    def call(self, requests: DataFrame, function, status: Column) -> None:
        """Intents first, then the calls of exactly these intents."""
        name = uuid.uuid4().hex
        path = f"{self.root}/intents/round={name}"
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        requests.repartition(partitions, "idempotency_key").write.parquet(path)
        intents = self.spark.read.schema(INTENT).parquet(path)
        if not intents.isEmpty():
            answers = intents.mapInPandas(_call(function), ANSWER)
            self._append(answers.select("idempotency_key", "attempt", status.alias("status"), "response"), name)


def batch_infer(
    requests: DataFrame,
    ledger: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    is_valid: Callable[[Column], Column],
    root: str | None = None,
) -> DataFrame:
    """Ledger rows of all runs with this folder: `idempotency_key, attempt, status, response`.

    requests: `idempotency_key, prompt`; ledger: `idempotency_key, status` of what was settled elsewhere. The function
    gets Arrow batches of `idempotency_key, prompt, attempt` and answers with `response` and `delivery` (`completed`,
    `ambiguous` or `rejected`). Without a `root` the folder is a new one, for a run that nobody continues.
    """
    spark = requests.sparkSession
    log = Ledger(spark, root or f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}")
    status = (
        F.when(F.col("delivery") == "ambiguous", "delivery_ambiguous")
        .when(F.col("delivery") != "completed", "explicit_failure")
        .when(is_valid(F.col("response")), "succeeded")
        .otherwise("invalid_response")
    )
    log.recover()
    new = pending_requests(requests, ledger).join(log.intents(), "idempotency_key", "left_anti")
    log.call(new.select("idempotency_key", "prompt", F.lit(1).alias("attempt")), function, status)
    tried = log.intents().groupBy("idempotency_key").agg(F.max("attempt").alias("tried"))
    invalid = log.attempts().where("status = 'invalid_response' AND attempt = 1").join(tried.where("tried = 1"), "idempotency_key")
    again = log.intents().where("attempt = 1").join(invalid.select("idempotency_key"), "idempotency_key", "left_semi")
    log.call(materialize(again.withColumn("attempt", F.lit(2))), function, status)
    return log.attempts()
