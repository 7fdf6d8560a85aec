"""Artifacts, checkpoints, lineage and run history as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.chains import chain_roots
from palimpsest.functions.hashing import content_hash, framed
from palimpsest.functions.ordered import previous, running

# Which stage feeds which. Fewer than 200 rows, so closures are broadcast.
STAGE_EDGES = (
    ("job_input", "correction_transcript"),
    ("media_probe", "timeline_audio"),
    ("timeline_audio", "media_object"),
    ("media_object", "base_asr"),
    ("media_object", "peer_asr"),
    ("media_object", "ata_response"),
    ("base_asr", "asr_comparison"),
    ("peer_asr", "asr_comparison"),
    ("asr_comparison", "correction_transcript"),
    ("correction_transcript", "merge_plan"),
    ("merge_plan", "selection_batch"),
    ("merge_plan", "edit_resolution"),
    ("selection_batch", "selection_result"),
    ("selection_result", "edit_resolution"),
    ("edit_resolution", "review_queue"),
    ("edit_resolution", "review_resolution"),
    ("edit_resolution", "transcript"),
    ("transcript", "ata_response"),
    ("ata_response", "ata_result"),
    ("ata_result", "srt_render"),
)
# Stages whose checkpoints belong to all rounds of a run.
SHARED_STAGES = (
    "media_probe", "timeline_audio", "media_object", "base_asr", "peer_asr", "asr_comparison",
)
# The stage that a paid operation produces; operations are named by what they do.
OPERATION_STAGES = (
    ("media_upload", "media_object"),
    ("transcribe_base", "base_asr"),
    ("transcribe_peer", "peer_asr"),
    ("correction_a", "correction_transcript"),
    ("correction_b", "correction_transcript"),
    ("selection", "selection_result"),
    ("alignment", "ata_response"),
)
RUN_STATES = (
    "queued", "running", "needs_review", "succeeded", "failed", "cancelled", "interrupted",
)


def content_identity(
    kind: Column, scope: Column, version: Column, producer: list[Column],
    inputs: list[Column], payload: list[Column],
) -> Column:
    """Hash of the semantic content. The patch level of the version does not take part."""
    release = F.regexp_extract(version, r"\A([0-9]+\.[0-9]+)\.[0-9]+\z", 1)
    return content_hash(
        framed(kind, scope, release, framed(*producer), framed(*inputs), framed(*payload))
    )


def stage_closure(spark: SparkSession) -> DataFrame:
    """All `root, stage` pairs with `stage` downstream of `root`, from the constant edges."""
    pairs = set(STAGE_EDGES)
    while True:
        longer = {(a, d) for a, b in pairs for c, d in STAGE_EDGES if b == c} - pairs
        if not longer:
            return spark.createDataFrame(sorted(pairs), "root string, stage string")
        pairs |= longer


def operation_stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OPERATION_STAGES), "operation string, stage string")


def latest_attempts(invocations: DataFrame) -> DataFrame:
    """Last call per logical operation and round, by (created_at, invocation_id)."""
    last = F.max_by(
        F.struct("invocation_id", "operation", "scope", "status"),
        F.struct("created_at", "invocation_id"),
    )
    return (
        invocations.groupBy("run_id", "round", "logical_key")
        .agg(last.alias("last"))
        .select("run_id", "round", "logical_key", "last.*")
    )


def downstream_stages(roots: DataFrame, closure: DataFrame) -> DataFrame:
    """`run_id, stage` roots -> all stages behind them."""
    pairs = roots.distinct().withColumnRenamed("stage", "root")
    return pairs.join(closure, "root").select("run_id", "stage").distinct()


def invalidate(
    roots: DataFrame, closure: DataFrame, checkpoints: DataFrame, rounds: DataFrame,
    pointers: DataFrame,
) -> DataFrame:
    """Checkpoints of the current round to drop and pointers to mark stale."""
    touched = roots.unionByName(downstream_stages(roots, closure)).distinct()
    current = F.when(F.col("stage").isin(*SHARED_STAGES), 0).otherwise(F.col("current_round"))
    dropped = (
        checkpoints.join(touched, ["run_id", "stage"], "left_semi")
        .join(rounds, "run_id")
        .where(F.col("round") == current)
        .select("run_id", "stage", "scope", "artifact_id", F.lit("drop_checkpoint").alias("action"))
    )
    stale = pointers.join(touched, ["run_id", "stage"], "left_semi").select(
        "run_id", "stage", "scope", "artifact_id", F.lit("mark_stale").alias("action")
    )
    return dropped.unionByName(stale)


def unknown_operations(latest: DataFrame, stages: DataFrame) -> DataFrame:
    """`run_id, operation` of failed calls that no stage is known for; nothing of such a run is carried over."""
    failed = latest.where(F.col("status") != "succeeded")
    return failed.join(stages, "operation", "left_anti").select("run_id", "operation").distinct()


def retry_carryover(
    prior: DataFrame, latest: DataFrame, runs: DataFrame, closure: DataFrame, stages: DataFrame,
    unavailable: DataFrame | None = None,
) -> DataFrame:
    """Checkpoints of a finished round that the next round may keep.

    Left out are all stages behind a failed operation, and a failed stage in its own scope
    only, so the sibling stays. A round without any failure and without `unavailable` references
    (`run_id`) in a succeeded run redoes the correction and everything behind it. A failed
    operation without a known stage keeps nothing of its run.
    """
    failed = latest.where(F.col("status") != "succeeded")
    failures = failed.join(stages, "operation").select("run_id", "stage", "scope")
    strange = unknown_operations(latest, stages).select("run_id").distinct()
    prior = prior.join(strange, "run_id", "left_anti")
    behind = downstream_stages(failures.select("run_id", "stage"), closure)
    unclean = failed.select("run_id")
    if unavailable is not None:
        unclean = unclean.unionByName(unavailable.select("run_id"))
    clean = runs.where(F.col("status") == "succeeded").join(unclean.distinct(), "run_id", "left_anti")
    redo = clean.select("run_id", F.lit("correction_transcript").alias("stage"))
    redo = redo.unionByName(downstream_stages(redo, closure))
    excluded = behind.unionByName(redo).distinct()
    return prior.join(excluded, ["run_id", "stage"], "left_anti").join(
        failures, ["run_id", "stage", "scope"], "left_anti"
    )


def dependents(artifacts: DataFrame, inputs: DataFrame, kind: str) -> DataFrame:
    return (
        artifacts.where(F.col("kind") == kind)
        .join(inputs.where(F.col("input_artifact_id").isNotNull()), ["run_id", "artifact_id"])
        .select("run_id", "input_artifact_id", "artifact_id", "created_at")
    )


def dangling_references(artifacts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs whose artifact is absent, and inputs naming both or neither kind of source."""
    known = artifacts.select("run_id", F.col("artifact_id").alias("input_artifact_id"))
    absent = (
        inputs.where(F.col("input_artifact_id").isNotNull())
        .join(known, ["run_id", "input_artifact_id"], "left_anti")
        .select("run_id", "artifact_id", "ordinal", F.lit("absent_artifact").alias("code"))
    )
    both = F.col("input_artifact_id").isNull() == F.col("input_source_id").isNull()
    unclear = inputs.where(both).select(
        "run_id", "artifact_id", "ordinal", F.lit("not_exactly_one_source").alias("code")
    )
    return absent.unionByName(unclear)


def artifact_upsert(existing: DataFrame, incoming: DataFrame, scope: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Insert absent ids; the same id with other content is a collision.

    A new id whose content the run already has under the same `scope` columns is `duplicate_content`; of new ids that
    arrive with one content the smallest is inserted. An unknown (null) content equals no other.
    """
    columns = ["run_id", "artifact_id", *scope, "content_hash"]
    stored = existing.select(*columns, F.lit(True).alias("stored"))
    return upsert_outcomes(stored.unionByName(incoming.select(*columns, F.lit(False).alias("stored"))), scope)


def upsert_outcomes(rows: DataFrame, scope: tuple[str, ...] = ("kind",)) -> DataFrame:
    """`artifact_upsert` of stored and arriving rows in one frame: `run_id, artifact_id, scope, content_hash, stored`.

    Rows of both sides meet once by id and once by content. Contents are aggregated, not gathered, however frequent.
    """
    keys, content, new = ["run_id", "artifact_id"], [*scope, "content_hash"], ~F.col("stored")
    sides = rows.groupBy(*keys).agg(
        *[F.min(F.when(new, F.col(c))).alias(c) for c in content],
        F.max(F.when(new, F.col("content_hash"))).alias("other_hash"),
        F.collect_set(F.when(F.col("stored"), F.struct(*content, "stored"))).alias("held"),
        F.bool_or(new).alias("arrives"),
    )
    outcome = (
        F.when(F.col("content_hash") != F.col("other_hash"), "collision")
        .when(F.exists("held", lambda h: h["content_hash"] == F.col("content_hash")), "unchanged")
        .when(F.size("held") > 0, "collision")
    )
    own = F.array(F.struct(*content, F.lit(False).alias("stored")))
    both = sides.select(*keys, "arrives", outcome.alias("outcome"), F.inline(F.concat("held", own)))
    both = both.where(F.col("stored") | F.col("arrives"))
    undecided = new & F.col("outcome").isNull()
    owners = both.where(F.col("stored") | undecided).groupBy("run_id", *content).agg(
        F.min(F.when(undecided, F.col("artifact_id"))).alias("first"), F.bool_or("stored").alias("had")
    )
    later = F.col("had") | (F.col("artifact_id") > F.col("first"))
    return both.where(new).join(owners, ["run_id", *content], "left").select(
        *keys, F.coalesce("outcome", F.when(later, "duplicate_content"), F.lit("inserted")).alias("outcome")
    )


def current_pointers(activations: DataFrame, stales: DataFrame) -> DataFrame:
    """Latest activated artifact per (run, kind, scope); stale if marked after that.

    A stale mark without scope covers all scopes of its kind.
    """
    keys = ["run_id", "kind", "scope"]
    current = activations.groupBy(*keys).agg(
        F.max("seq").alias("seq"), F.max_by("artifact_id", "seq").alias("artifact_id")
    )
    one = stales.where(F.col("scope").isNotNull()).groupBy(*keys).agg(F.max("seq").alias("s1"))
    wide = (
        stales.where(F.col("scope").isNull()).groupBy("run_id", "kind").agg(F.max("seq").alias("s2"))
    )
    joined = current.join(one, keys, "left").join(wide, ["run_id", "kind"], "left")
    last = F.coalesce(F.greatest("s1", "s2"), F.lit(-1))
    return joined.select(*keys, "artifact_id", (last > F.col("seq")).alias("is_stale"))


def retry_chains(invocations: DataFrame, identity: list[str]) -> DataFrame:
    """Root and depth of each retry, and whether it kept the identity of its ancestor."""
    roots = chain_roots(
        invocations.select(F.col("invocation_id").alias("id"), F.col("retry_of").alias("parent"))
    )
    parent = invocations.select(
        F.col("invocation_id").alias("retry_of"), *[F.col(c).alias(f"was_{c}") for c in identity]
    )
    changed = F.lit(False)
    for c in identity:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return (
        invocations.join(parent, "retry_of", "left")
        .join(roots, F.col("invocation_id") == F.col("id"))
        .select(
            "invocation_id",
            "root",
            "depth",
            (F.col("retry_of").isNotNull() & changed).alias("identity_changed"),
        )
    )


def crash_recovery(runs: DataFrame, invocations: DataFrame) -> DataFrame:
    """State changes for runs that were running: calls first, then the runs themselves."""
    running = runs.where(F.col("status") == "running").select("run_id")
    status = F.when(F.col("status") == "created", "definitely_not_sent").when(
        F.col("status") == "sending", "delivery_ambiguous"
    )
    calls = invocations.where(F.col("status").isin("created", "sending")).join(
        running, "run_id", "left_semi"
    )
    return calls.select(
        F.lit("invocation").alias("subject"), "run_id", "invocation_id",
        status.alias("new_status"),
    ).unionByName(
        running.select(
            F.lit("run").alias("subject"), "run_id",
            F.lit(None).cast("long").alias("invocation_id"),
            F.lit("interrupted").alias("new_status"),
        )
    )


def usage_ledger(invocations: DataFrame) -> DataFrame:
    """Usage over all attempts. Unknown usage (NULL or JSON null) is counted, never zero."""
    usage = F.get_json_object("usage_json", "$.k").cast("long")
    unknown = F.col("usage_json").isNull() | (F.col("usage_json") == "null")
    return invocations.groupBy("run_id", "provider").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.sum(F.when(~unknown, usage)).alias("known_usage"),
        F.count_if(unknown).alias("unknown_usage"),
    )


def latest_references(preparations: DataFrame, current_round: int, width: int = 65_536) -> DataFrame:
    """Latest preparation per (run, ordinal) up to a round; available ones get dense ordinals.

    A second row of the same round is ignored. An available reference is immutable: the first round that has
    it wins, and `later_rounds` counts the rounds reported after it.
    """
    first = (
        preparations.where(F.col("round") <= current_round)
        .groupBy("run_id", "ordinal", "round")
        .agg(F.min_by("status", "seq").alias("status"))
    )
    found = F.min(F.when(F.col("status") == "available", F.col("round")))
    latest = first.groupBy("run_id", "ordinal").agg(
        F.coalesce(found, F.max("round")).alias("round"),
        F.when(found.isNotNull(), "available").otherwise(F.max_by("status", "round")).alias("status"),
        F.when(found.isNotNull(), F.max("round") - found).otherwise(0).cast("long").alias("later_rounds"),
    )
    available = F.col("status") == "available"
    numbered = running(
        latest.withColumn("part", F.floor(F.col("ordinal") / width)),
        ["run_id"], ["ordinal"], "part",
        upto=("sum", F.when(available, 1).otherwise(0)),
    )
    return numbered.withColumn(
        "effective_ordinal", F.when(available, F.col("upto") - 1)
    ).drop("part", "upto")


def checkpoint_upsert(requests: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Final checkpoint per key: revision grows with each other artifact; digests must agree."""
    keys = ["run_id", "round", "stage", "scope"]
    rows = previous(
        requests.withColumn("part", F.floor(F.col("seq") / width)),
        keys, ["seq"], "part", before=F.col("artifact_id"),
    )
    changed = F.col("before").isNull() | (F.col("before") != F.col("artifact_id"))
    # min/max instead of a distinct count: both combine before the shuffle
    merged = rows.groupBy(*keys).agg(
        F.max_by("artifact_id", "seq").alias("artifact_id"),
        F.count_if(changed).alias("revision"),
        F.min("input_digest").alias("d1"),
        F.max("input_digest").alias("d2"),
        F.bool_or(F.col("artifact_stage") != F.col("stage")).alias("other_kind"),
    )
    outcome = (
        F.when(F.col("d1") != F.col("d2"), "input_changed")
        .when(F.col("other_kind"), "kind_mismatch")
        .otherwise("stored")
    )
    return merged.select(*keys, "artifact_id", "revision", outcome.alias("outcome"))


def run_status(events: DataFrame, runs: DataFrame, project_id: Column) -> DataFrame:
    """Latest state of the runs of one project (NULL selects runs without a project)."""
    latest = events.groupBy("run_id").agg(
        F.max_by(F.struct("status", "stage"), "event_id").alias("last"),
        F.count_if(~F.col("status").isin(*RUN_STATES)).alias("unknown_states"),
    )
    chosen = runs.where(F.col("project_id").eqNullSafe(project_id)).select("run_id")
    return latest.join(chosen, "run_id", "left_semi").select(
        "run_id", "last.status", "last.stage", "unknown_states"
    )


def orphan_objects(transfers: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Which transferred objects nothing names any more. Active runs are left alone.

    The values of `object_key` members are read as JSON strings, so escaped keys count. Nothing of a run
    with a malformed document is removed (`unreadable`).
    """
    strings = F.regexp_extract_all(
        "body", F.lit(r'"object_key"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1)
    )
    decoded = F.transform(strings, lambda s: F.get_json_object(F.concat(F.lit('{"k":'), s, F.lit("}")), "$.k"))
    named = documents.select("run_id", F.explode(decoded).alias("object_key")).distinct()
    broken = documents.where(F.try_parse_json("body").isNull()).select("run_id").distinct()
    marked = (
        transfers.join(named.withColumn("named", F.lit(True)), ["run_id", "object_key"], "left")
        .join(runs.select("run_id", "status"), "run_id")
        .join(broken.withColumn("broken", F.lit(True)), "run_id", "left")
    )
    action = (
        F.when(F.col("broken"), "unreadable")
        .when(F.col("status").isin("queued", "running", "needs_review"), "active_run")
        .when((F.col("state") == "bound") | F.col("named"), "protected")
        .otherwise("would_remove")
    )
    return marked.select("run_id", "transfer_id", action.alias("action"))


def transfer_resume(intents: DataFrame, transfers: DataFrame, listing: DataFrame) -> DataFrame:
    """What to do for each upload intent, given earlier transfers and the stored objects."""
    keys = ["run_id", "purpose", "content_hash"]
    latest = (
        transfers.where(F.col("state") != "removed")
        .groupBy(*keys)
        .agg(
            F.max_by(
                F.struct("transfer_id", "state", "object_key"), F.struct("created_at", "transfer_id")
            ).alias("t")
        )
    )
    joined = (
        intents.select(*keys)
        .distinct()
        .join(latest, keys, "left")
        .withColumn("object_key", F.col("t.object_key"))
        .join(listing.withColumn("stored", F.lit(True)), "object_key", "left")
    )
    action = (
        F.when(F.col("t").isNull(), "new_upload")
        .when(F.col("t.state").isin("persisted", "bound"), "reuse")
        .when(F.col("stored"), "adopt_stored")
        .otherwise("upload_same_key")
    )
    return joined.select(*keys, F.col("t.transfer_id").alias("transfer_id"), action.alias("action"))


def run_results(runs: DataFrame, invocations: DataFrame, *, width: int = 1000) -> DataFrame:
    """Result document per run and round, in parts that hold at most `width` call ids each."""
    call = F.struct(
        "invocation_id",
        "status",
        F.get_json_object("usage_json", "$.k").cast("long").alias("usage"),
    )
    parts = (
        invocations.withColumn("part", F.floor(F.col("invocation_id") / width))
        .groupBy("run_id", "round", "part")
        .agg(F.sort_array(F.collect_list(call)).alias("invocations"))
    )
    failed = F.col("status").isin("failed", "interrupted")
    document = F.struct(
        F.lit("1.0").alias("contract_version"),
        F.col("run_id"),
        F.col("project_id"),
        F.col("round").alias("execution_round"),
        F.col("status"),
        F.struct("invocations").alias("usage"),
        F.when(failed, F.when(F.col("status") == "interrupted", "interrupted").otherwise(
            "run_failed")).alias("error"),
    )
    return parts.join(runs, "run_id").select(
        "run_id", "round", "part",
        F.to_json(document, {"ignoreNullFields": "false"}).alias("result_json"),
    )


def export_audit(exports: DataFrame, pointers: DataFrame, checkpoints: DataFrame,
                 resolutions: DataFrame, media: DataFrame, calls: DataFrame) -> DataFrame:
    """Codes of everything that forbids publishing a run's subtitles."""
    joined = (
        exports.join(pointers, ["run_id", "artifact_id"], "left")
        .join(checkpoints, "run_id", "left")
        .join(resolutions, "run_id", "left")
        .join(media, "run_id", "left")
        .join(calls, "run_id", "left")
    )
    rules = (
        ("not_current", F.col("is_stale").isNull() | F.col("is_stale")),
        ("checkpoint", ~F.col("checkpoint_artifact_id").eqNullSafe(F.col("artifact_id"))),
        (
            "not_sealed",
            ~F.coalesce("sealed", F.lit(False)) | (F.coalesce("pending", F.lit(1)) > 0),
        ),
        ("media_bytes", ~F.col("media_hash").eqNullSafe(F.col("audio_hash"))),
        ("inputs", ~F.col("input_roles").eqNullSafe(F.lit("media_object,timeline_audio,transcript"))),
        ("call", ~F.col("call_status").eqNullSafe(F.lit("succeeded"))),
        ("text", ~F.col("request_text").eqNullSafe(F.col("sealed_text"))),
    )
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    return joined.select("run_id", F.array_join(codes, ",").alias("codes")).where(
        F.col("codes") != ""
    )


def latency_quantiles(samples: DataFrame) -> DataFrame:
    """Exact median, nearest-rank 95th percentile and maximum per operation.

    samples: `operation, value` (integer). Equal values are counted before the shuffle, and
    ranks come from sliced running sums, so no operation is sorted in one task.
    """
    counts = samples.groupBy("operation", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(
        counts.withColumn("part", F.floor(F.col("value") / 1000)),
        ["operation"], ["value"], "part", upto=("sum", F.col("n")),
    )
    totals = counts.groupBy("operation").agg(
        F.sum("n").alias("samples"), F.max("value").alias("largest")
    )
    scaled = F.col("samples") * 95
    whole, rest = F.floor(scaled / 100), scaled % 100
    p95 = F.greatest(
        F.when(rest > 50, whole + 1).when(rest == 50, whole + whole % 2).otherwise(whole), F.lit(1)
    )
    lower, upper = F.floor((F.col("samples") + 1) / 2), F.floor(F.col("samples") / 2) + 1
    joined = ranked.join(totals, "operation")

    def at(rank: Column) -> Column:
        return F.max(
            F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col("value"))
        )

    return joined.groupBy("operation").agg(
        F.max("samples").alias("samples"),
        (at(lower) + at(upper)).alias("median_x2"),
        at(p95).alias("p95"),
        F.max("largest").alias("largest"),
    )
