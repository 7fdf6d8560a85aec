"""Headline queries timed on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from palimpsest.plans import catalog

# the shared steps of a chain are built by the first query that needs them
HEADLINE = (
    "reconcile",
    "diff_hunks",
    "budget_batches",
    "review_resolution",
    "utterance_diagnostics",
    "srt_render",
    "content_id",
    "current_pointer",
    "retry_chain",
    "usage_ledger",
    "active_sessions",
    "rate_limit_replay",
    "reputation_replay",
    "reputation_audit",
    "pseudonymize",
    "timeline_actions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    spark.read.parquet(f"{folder}/region.parquet").count()
    for key in HEADLINE:
        begin = time.time()
        catalog.QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("/sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
