"""Registered streaming, inference and contract queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.hashing import text_id
from palimpsest.functions.materialize import shared_folder
from palimpsest.operators import contracts
from palimpsest.operators.infer import batch_infer
from palimpsest.plans import queries_accounts, queries_ledger, queries_text
from palimpsest.plans.queries_accounts import LIMIT, with_
from palimpsest.plans.recipes import RECIPES, recipe, recipe_sql
from palimpsest.plans.recipes_text import with_variants
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import table, wall_ms
from palimpsest.streaming import jobs

registry = Registry()
query = registry.query


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.table_stream(spark, folder, "events").withColumn("ms", wall_ms(F.col("ts")))


def _stream_recipe(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A recipe that only projects events, over the event stream."""
    return spark.sql(RECIPES[name][1], ev=_event_stream(spark, folder))


@query(
    "progress_stream",
    with_(recipe_sql("progress"))
    + "SELECT run_id, max(event_id) AS event_id, arg_max(status, event_id) AS status, "
    "arg_max(stage, event_id) AS stage FROM progress GROUP BY run_id",
)
def progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    feed = _stream_recipe(spark, folder, "progress")
    return jobs.latest_update(jobs.run_to_table(jobs.progress_stream(feed), "update"), "run_id")


@query("rate_limit_stream", queries_accounts.ORACLES["rate_limit_replay"])
def rate_limit_stream(spark: SparkSession, folder: str) -> DataFrame:
    attempts = _stream_recipe(spark, folder, "attempts")
    return jobs.rate_limit_to_table(attempts, LIMIT).drop("batch_id")


@query(
    "reuse_stream",
    with_(
        recipe_sql("sessions"),
        "uses AS (SELECT *, created_at + CAST(floor(value * 100000000) AS BIGINT) AS used_at "
        "FROM sessions)",
    )
    + "SELECT family_id, min(used_at) AS reused_at FROM uses WHERE replaced_by IS NOT NULL "
    "AND used_at >= revoked_at GROUP BY family_id",
)
def reuse_stream(spark: SparkSession, folder: str) -> DataFrame:
    uses = recipe(spark, folder, "sessions").select(
        "family_id",
        "session_id",
        (F.col("created_at") + F.floor(F.col("value") * 100_000_000)).alias("used_at"),
        F.when(F.col("replaced_by").isNotNull(), F.col("revoked_at")).alias("replaced_at"),
    )
    feed = _replayed(uses, "uses")
    found = jobs.run_to_table(jobs.reuse_stream(feed), "append")
    return found.groupBy("family_id").agg(F.min("reused_at").alias("reused_at"))


def _replayed(rows: DataFrame, name: str) -> DataFrame:
    """Recorded rows written once to the shared folder and read back as a stream of at least three batches."""
    import uuid

    spark = rows.sparkSession
    root = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    rows.repartition(3).write.parquet(f"{root}/{name}.parquet")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}.parquet")


@query(
    "reputation_stream",
    with_(*queries_ledger._ALL, queries_ledger.replay_sql("projection", "ledger"))
    + "SELECT * FROM projection",
)
def reputation_stream(spark: SparkSession, folder: str) -> DataFrame:
    log = queries_ledger.ledger(spark, folder).select(
        "phone", "generation", "sequence", "event_type", "to_status", "created_at"
    )
    states = jobs.run_to_table(jobs.reputation_stream(_replayed(log, "log")), "update")
    if not states.where("outcome = 'quarantined'").isEmpty():
        raise ValueError("the ledger repeats or contradicts a sequence number")
    newest = (
        states.where(F.col("outcome") == "projected")
        .groupBy("phone", "generation")
        .agg(
            F.max_by(
                F.struct("ban_count", "status", "blocked_at", "last_ban_at"), "batch_id"
            ).alias("s")
        )
    )
    return newest.select("phone", "generation", "s.*")


@query(
    "security_event_dedupe",
    "SELECT event_id, user_id, event_type FROM events",
)
def security_event_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    copies = F.when(F.col("event_id") % 3 == 0, 2).otherwise(1)
    columns = ("event_id", "user_id", "event_type")
    feed = _event_stream(spark, folder).select(
        *columns, "ms", F.explode(F.sequence(F.lit(1), copies)).alias("copy")
    )
    unique, late = jobs.dedupe_to_table(feed, "event_id", "ms")
    return unique.select(*columns).unionByName(late.select(*columns).distinct())


@query("stream_ingest_reconcile", queries_text.ORACLES["reconcile"])
def stream_ingest_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    feed = jobs.table_stream(spark, folder, "documents")
    identity = text_id("set_", *[F.col(c) for c in ("doc_id", "base", "a", "b")])
    return jobs.reconcile_stream(feed, with_variants, identity)


def _measure(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic local model: answers with the prompt's length, sometimes badly."""
    number = batch["idempotency_key"].str.slice(4).astype("int64")
    answer = '{"n":' + batch["prompt"].str.len().astype(str) + "}"
    bad = (number % 7 == 0) & ((batch["attempt"] == 1) | (number % 49 == 0))
    delivery = pd.Series("completed", index=batch.index)
    delivery[number % 11 == 5] = "ambiguous"
    delivery[number % 13 == 5] = "rejected"
    return batch.assign(response=answer.mask(bad, "not json"), delivery=delivery)


_STATUS = """CASE WHEN doc_id % 13 = 5 THEN 'explicit_failure'
  WHEN doc_id % 11 = 5 THEN 'delivery_ambiguous' WHEN {bad} THEN 'invalid_response'
  ELSE 'succeeded' END"""


@query(
    "batch_infer",
    f"""WITH todo AS (SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 5 > 1),
first_ AS (SELECT doc_id, n, 1 AS attempt, {_STATUS.format(bad='doc_id % 7 = 0')} AS status,
  doc_id % 7 = 0 AS bad FROM todo),
all_ AS (SELECT * FROM first_ UNION ALL SELECT doc_id, n, 2,
  {_STATUS.format(bad='doc_id % 49 = 0')}, doc_id % 49 = 0 FROM first_
  WHERE status = 'invalid_response')
SELECT 'req_' || doc_id AS idempotency_key, attempt, status,
  CASE WHEN bad THEN 'not json' ELSE '{{"n":' || n || '}}' END AS response FROM all_""",
)
def batch_infer_query(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(F.lit("req_"), F.col("doc_id").cast("string")).alias("idempotency_key")
    documents = table(spark, folder, "documents")
    requests = documents.select(key, F.col("text").alias("prompt"))
    kind = F.col("doc_id") % 5
    ledger = documents.where(kind <= 1).select(
        key, F.when(kind == 0, "succeeded").otherwise("delivery_ambiguous").alias("status")
    )
    return batch_infer(
        requests, ledger, _measure, lambda response: F.try_parse_json(response).isNotNull()
    )


_KINDS = tuple(contracts.PAYLOAD_RULES)
_SAMPLE = {"positive": "7", "count": "0", "list": "[]", "object": "{}", "bool": "true"}


def _sample_payload(rules) -> str:
    """A payload that satisfies the rules; `@` stands where the document text goes."""
    tree: dict = {}
    for path, kind in rules:
        node = tree
        *parents, leaf = path.split(".")
        for parent in parents:
            node = node.setdefault(parent, {})
        if kind in ("text", "string"):
            node[leaf] = "@"
        else:
            node[leaf] = _SAMPLE.get(kind, f'"{kind.split("|")[0]}"')

    def write(node) -> str:
        if isinstance(node, str):
            return node
        return "{" + ",".join(f'"{k}":{write(v)}' for k, v in node.items()) + "}"

    return write(tree)


def _contract_oracle() -> str:
    index = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))
    missing = " ".join(
        f"WHEN {i} THEN '" + ",".join(p for p, _ in contracts.PAYLOAD_RULES[k]) + "'"
        for i, k in enumerate(_KINDS)
    )
    scoped = ", ".join(str(_KINDS.index(k)) for k in contracts.SCOPED_KINDS)
    n = len(_KINDS)
    return f"""SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN CASE doc_id % {n} {index} END END
  AS kind, CASE doc_id % 7 WHEN 3 THEN 'malformed_json'
  WHEN 1 THEN CASE WHEN doc_id % {n} IN ({scoped}) THEN 'scope_key,' ELSE '' END ||
    CASE doc_id % {n} {missing} END
  WHEN 2 THEN 'envelope_fields' WHEN 4 THEN 'schema_version' WHEN 5 THEN 'scope_key' ELSE '' END
  AS codes FROM documents"""


@query("payload_contract", _contract_oracle())
def payload_contract(spark: SparkSession, folder: str) -> DataFrame:
    fault, which = F.col("doc_id") % 7, F.col("doc_id") % len(_KINDS)
    text = F.to_json(F.array("text"))
    quoted = F.substring(text, F.lit(2), F.length(text) - 2)
    payload = kind = scope = None
    for i, (name, rules) in enumerate(contracts.PAYLOAD_RULES.items()):
        body = F.replace(F.lit(_sample_payload(rules)), F.lit("@"), quoted)
        field = contracts.SCOPED_KINDS.get(name)
        own = F.lit('"global"') if field is None else F.lit('"a"') if field == "arm" else quoted
        if payload is None:
            payload, kind, scope = F.when(which == i, body), F.when(which == i, name), F.when(which == i, own)
        else:
            payload, kind, scope = payload.when(which == i, body), kind.when(which == i, name), scope.when(which == i, own)
    body = F.concat(
        F.lit('{"schema_version":"'), F.when(fault == 4, "11.0.0").otherwise("12.0.0"),
        F.lit('","artifact_id":"art","artifact_kind":"'), kind, F.lit('","scope_key":'),
        F.when(fault == 5, '"elsewhere"').otherwise(scope),
        F.lit(',"content_hash":"h","created_at":"t","producer":{},"inputs":[],"payload":'),
        F.when(fault == 1, "{}").otherwise(payload),
        F.when(fault == 2, ',"extra":1}').when(fault == 3, ',"payload":1}').otherwise("}"),
    )
    return contracts.payload_contract(
        table(spark, folder, "documents").select("doc_id", body.alias("body"))
    )


QUERIES, ORACLES = registry.queries, registry.oracles
