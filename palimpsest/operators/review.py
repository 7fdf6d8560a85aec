"""Patches, sealing, the review queue and human review decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import text_id
from palimpsest.functions.ordered import following
from palimpsest.functions.text import piece
from palimpsest.operators.reconcile import apply_edits

# Base positions per slice, so that one document's patches need not meet in one task.
SLICE = 65_536


def checked_patches(texts: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply patches per document, or reject the document with the first reason found.

    Rejected are intervals outside the text, overlaps, equal starts, and patches whose
    `original` is no longer what the base holds.
    """
    sliced = patches.withColumn("part", F.floor(F.col("start") / SLICE))
    ahead = following(sliced, ["doc_id"], ["start", "end"], "part", next=F.col("start"))
    joined = ahead.join(texts.select("doc_id", "base"), "doc_id")
    outside = (
        (F.col("start") < 0)
        | (F.col("start") > F.col("end"))
        | (F.col("end") > F.length("base"))
    )
    clash = (F.col("end") > F.col("next")) | (F.col("start") == F.col("next"))
    stale = piece(F.col("base"), F.col("start"), F.col("end")) != F.col("original")
    flags = joined.groupBy("doc_id").agg(
        F.bool_or(outside).alias("outside"),
        F.bool_or(F.coalesce(clash, F.lit(False))).alias("clash"),
        F.bool_or(stale).alias("stale"),
    )
    reason = (
        F.when(F.col("outside"), "out_of_range")
        .when(F.col("clash"), "overlap")
        .when(F.col("stale"), "stale_original")
    )
    verdicts = flags.select("doc_id", reason.alias("reason"))
    accepted = patches.join(
        verdicts.where(F.col("reason").isNotNull()), "doc_id", "left_anti"
    ).select("doc_id", "start", "end", "replacement")
    rebuilt = apply_edits(texts, accepted, "text")
    return rebuilt.join(verdicts, "doc_id", "left").select(
        "doc_id",
        F.coalesce("reason", F.lit("applied")).alias("outcome"),
        F.when(F.col("reason").isNull(), F.col("text")).alias("text"),
    )


def review_items(cases: DataFrame, coverage: DataFrame) -> DataFrame:
    """Cases that need a person: too big for a batch, or in a batch without a valid answer."""
    answered = coverage.where("valid").select("doc_id", "batch_id")
    failed = (
        cases.where(F.col("batch_id").isNotNull())
        .join(answered, ["doc_id", "batch_id"], "left_anti")
        .withColumn("reason", F.lit("selection_unavailable"))
    )
    overflow = cases.where(F.col("batch_id").isNull()).withColumn(
        "reason", F.lit("selection_input_budget_exceeded")
    )
    return failed.unionByName(overflow).withColumn(
        "review_id", F.concat(F.lit("rev_"), F.col("case_id"))
    )


def review_status(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Queue state per document: `clear` without items, else `needs_review`, with a queue id."""
    queues = items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.array_join(F.sort_array(F.collect_list("review_id")), ",").alias("ids"),
    )
    joined = texts.select("doc_id").join(queues, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce("items", F.lit(0)).cast("long").alias("items"),
        F.when(F.col("items").isNull(), "clear").otherwise("needs_review").alias("status"),
        text_id("queue_", F.col("doc_id"), F.coalesce("ids", F.lit("")), size=24).alias(
            "queue_id"
        ),
    )


def seal_gate(
    texts: DataFrame, edits: DataFrame, items: DataFrame, pending: DataFrame
) -> DataFrame:
    """A resolution is sealed when nothing waits for review or selection."""
    reviews = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("reviews"))
    waiting = pending.groupBy("doc_id").agg(F.count(F.lit(1)).alias("waiting"))
    rebuilt = apply_edits(texts, edits.select("doc_id", "start", "end", "replacement"))
    joined = rebuilt.join(reviews, "doc_id", "left").join(waiting, "doc_id", "left")
    count = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("reviews", "waiting")}
    return joined.select(
        "doc_id",
        count["reviews"].alias("review_items"),
        count["waiting"].alias("pending_selection"),
        ((count["reviews"] == 0) & (count["waiting"] == 0)).alias("sealed"),
        "preview",
    )


# What a reviewer may do with an item.
REVIEW_ACTIONS = ("keep", "a", "b", "peer", "replace")


def review_resolution(
    texts: DataFrame,
    resolved: DataFrame,
    items: DataFrame,
    queues: DataFrame,
    decisions: DataFrame,
) -> DataFrame:
    """Apply human decisions per document, all or nothing.

    decisions: doc_id, queue_id, review_id, action, replacement. A document is refused when
    its queue id is stale, when its items are not covered exactly once, when an action is
    unknown or lacks its replacement, or when the chosen source has no candidate.
    """
    waiting = queues.where(F.col("status") == "needs_review")
    current = decisions.join(
        waiting.select("doc_id", F.col("queue_id").alias("now_queue")), "doc_id"
    )
    stale = current.groupBy("doc_id").agg(
        F.bool_or(F.col("queue_id") != F.col("now_queue")).alias("stale")
    )
    given = current.groupBy("doc_id", "review_id").agg(
        F.count(F.lit(1)).alias("uses"),
        F.max("action").alias("action"),
        F.max("replacement").alias("replacement"),
    )
    matched = items.withColumn("known", F.lit(True)).join(
        given, ["doc_id", "review_id"], "full_outer"
    )
    action = F.col("action")
    text = (
        F.when(action == "keep", F.col("original"))
        .when(action == "a", F.col("a_text"))
        .when(action == "b", F.col("b_text"))
        .when(action == "peer", F.col("peer_text"))
        .when(action == "replace", F.col("replacement"))
    )
    matched = matched.withColumn("chosen", text)
    uncovered = F.col("known").isNull() | F.col("uses").isNull() | (F.col("uses") > 1)
    flags = matched.groupBy("doc_id").agg(
        F.bool_or(uncovered).alias("uncovered"),
        F.bool_or(~action.isin(*REVIEW_ACTIONS)).alias("bad_action"),
        F.bool_or(action.isin(*REVIEW_ACTIONS) & F.col("chosen").isNull()).alias("absent"),
    )
    outcome = (
        F.when(F.coalesce(F.col("stale"), F.lit(False)), "stale_queue")
        .when(F.col("uncovered"), "coverage")
        .when(F.coalesce(F.col("bad_action"), F.lit(False)), "unknown_action")
        .when(F.coalesce(F.col("absent"), F.lit(False)), "unavailable_candidate")
        .otherwise("resolved")
    )
    verdicts = (
        waiting.select("doc_id")
        .join(flags, "doc_id", "left")
        .join(stale, "doc_id", "left")
        .select("doc_id", outcome.alias("outcome"))
    )
    done = verdicts.where(F.col("outcome") == "resolved")
    manual = (
        matched.where(action != "keep")
        .join(done, "doc_id", "left_semi")
        .select("doc_id", "start", "end", F.col("chosen").alias("replacement"))
    )
    earlier = resolved.join(done, "doc_id", "left_semi").select(
        "doc_id", "start", "end", "replacement"
    )
    rebuilt = apply_edits(
        texts.join(done, "doc_id", "left_semi"), earlier.unionByName(manual), "text"
    )
    return verdicts.join(rebuilt, "doc_id", "left").select("doc_id", "outcome", "text")


def plan_audit(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of a stored plan that do not recompute, and recomputed rows it lacks."""
    columns = recomputed.columns
    forged = stored.select(columns).exceptAll(recomputed).withColumn("side", F.lit("stored"))
    absent = recomputed.exceptAll(stored.select(columns)).withColumn("side", F.lit("recomputed"))
    return forged.unionByName(absent)
