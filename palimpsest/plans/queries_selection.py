"""Registered conflict, batch and review queries over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.materialize import stage
from palimpsest.operators import reconcile as R
from palimpsest.operators import review as V
from palimpsest.operators import selection as S
from palimpsest.plans import oracle_selection as O
from palimpsest.plans.oracle_text import category_sql
from palimpsest.plans.recipes_text import transcripts
from palimpsest.plans.registry import Registry

registry = Registry()
query = registry.query

CASE_KEYS = ["doc_id", "case_id", "start", "end"]


class Chain:
    """The shared steps over one folder's documents, each written once and then read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.texts = transcripts(spark, folder)

        self._step = lambda name, build: stage(spark, folder, name, build)

    def aligned(self) -> DataFrame:
        """Components, the conflict cases among them without their contexts: one pass for both."""
        return self._step("aligned", lambda: S.document_components(self.texts))

    @property
    def components(self) -> DataFrame:
        return R.merge_states(self.aligned())

    def found(self) -> DataFrame:
        """Cases with their contexts, not written: the contexts are many times the texts."""
        return S.document_cases(self.texts)

    def full_cases(self) -> DataFrame:
        """Complete cases without their versions, whose size is in `bytes`."""
        return self._step("full_cases", lambda: S.complete_cases(S.conflict_rows(self.aligned())))

    def numbers(self) -> DataFrame:
        return self._step(
            "numbers", lambda: S.batch_ids(S.budget_batches(self.full_cases())).drop("bytes")
        )

    def batched(self) -> DataFrame:
        return self.full_cases().join(self.numbers(), CASE_KEYS)

    def placed(self) -> DataFrame:
        return self._step("batched", self.batched)

    @staticmethod
    def decisions(batched: DataFrame) -> DataFrame:
        digit = F.substring("batch_id", 7, 1)
        lead = F.col("place") == 1
        real = batched.where(F.col("batch_id").isNotNull())
        first = real.where(~((digit == "0") & lead)).select(
            "doc_id",
            "batch_id",
            F.when((digit == "3") & lead, "case_unknown").otherwise(F.col("case_id")).alias(
                "case_id"
            ),
            F.when((digit == "1") & lead, "c9").otherwise("c1").alias("candidate_id"),
        )
        again = real.where((digit == "2") & lead).select(
            "doc_id", "batch_id", "case_id", F.lit("c1").alias("candidate_id")
        )
        return first.unionByName(again)

    @staticmethod
    def wanted(batched: DataFrame) -> DataFrame:
        return batched.where(F.col("batch_id").isNotNull()).select(
            "doc_id",
            "batch_id",
            "case_id",
            F.transform("candidates", lambda c: c["candidate_id"]).alias("candidate_ids"),
        )

    def reviewed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Review items, decisions and coverage of the batched cases, and these cases."""
        batched = self.placed()
        decisions = self.decisions(batched)
        coverage = self._step("coverage", lambda: S.decision_coverage(self.wanted(batched), decisions))
        return self._step("items", lambda: V.review_items(batched, coverage)), coverage, batched

    def settled(self, coverage: DataFrame, batched: DataFrame) -> DataFrame:
        """The edits settled without a person."""
        selected = S.apply_selections(batched, coverage, self.decisions(batched))
        return (
            self.components.where(F.col("state") != "conflict")
            .select("doc_id", "start", "end", F.col("merged").alias("replacement"))
            .unionByName(selected.select("doc_id", "start", "end", "replacement"))
        )


_BATCHED = [O.TEXTS, O.CASES, O.CONTEXTS, O.full_sql(), O.pack_sql()]
_DECIDED = [*_BATCHED, O.DECISIONS, O.COVERAGE]
_REVIEWED = [*_DECIDED, O.SELECTED, O.REVIEWS]


@query(
    "candidates",
    O.with_(O.TEXTS, O.CASES)
    + "SELECT doc_id, case_id, text, array_to_string(sources, ',') AS sources, is_keep FROM cand",
)
def candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.candidate_rows(S.with_candidates(Chain(spark, folder).found()))
    return rows.select(
        "doc_id", "case_id", "text", F.array_join("sources", ",").alias("sources"), "is_keep"
    )


@query(
    "candidate_order",
    O.with_(O.TEXTS, O.CASES)
    + 'SELECT c.doc_id, c.case_id, k.start_ AS "start", k.end_ AS "end", candidate_id, c.text '
    "FROM cand c JOIN cases k ON k.doc_id = c.doc_id AND k.case_id = c.case_id",
)
def candidate_order(spark: SparkSession, folder: str) -> DataFrame:
    cases = S.with_candidates(Chain(spark, folder).found())
    return cases.select(
        "doc_id", "case_id", "start", "end", F.explode("candidates").alias("c")
    ).select("doc_id", "case_id", "start", "end", "c.candidate_id", "c.text")


@query(
    "context_window",
    O.with_(O.TEXTS, O.CASES, O.CONTEXTS)
    + 'SELECT doc_id, case_id, source, f AS "start", t AS "end", context_start, context_end, '
    "before, target, after FROM ctx",
)
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    return Chain(spark, folder).found().select(
        "doc_id", "case_id", F.explode("contexts").alias("c")
    ).select("doc_id", "case_id", *[f"c.{name}" for name in S.CONTEXT_FIELDS])


@query(
    "budget_batches",
    O.with_(*_BATCHED)
    + 'SELECT doc_id, case_id, start_ AS "start", end_ AS "end", bytes, batch_no, batch_id, '
    "place FROM batched",
)
def budget_batches(spark: SparkSession, folder: str) -> DataFrame:
    return S.batch_ids(S.budget_batches(Chain(spark, folder).full_cases())).select(
        "doc_id", "case_id", "start", "end", "bytes", "batch_no", "batch_id", "place"
    )


@query(
    "decision_coverage",
    O.with_(*_DECIDED)
    + "SELECT doc_id, batch_id, cases, CAST(decisions AS BIGINT) AS decisions, missing, "
    "duplicated, unknown_case, unknown_candidate, valid FROM coverage",
)
def decision_coverage(spark: SparkSession, folder: str) -> DataFrame:
    chain = Chain(spark, folder)
    batched = chain.placed()
    return S.decision_coverage(chain.wanted(batched), chain.decisions(batched))


@query(
    "decision_set_equality",
    O.with_(*_DECIDED)
    + """SELECT coalesce(w.doc_id, u.doc_id) AS doc_id, coalesce(w.batch_id, u.batch_id) AS batch_id,
       count(*) FILTER (u.case_id IS NULL) AS missing, count(*) FILTER (w.case_id IS NULL) AS extra,
       bool_and(u.case_id IS NOT NULL AND w.case_id IS NOT NULL) AS same_set,
       bool_and(coalesce(u.uses, 0) <= 1) AS unique_ids
FROM wanted w FULL OUTER JOIN usage u ON u.doc_id = w.doc_id AND u.batch_id = w.batch_id
  AND u.case_id = w.case_id GROUP BY 1, 2""",
)
def decision_set_equality(spark: SparkSession, folder: str) -> DataFrame:
    chain = Chain(spark, folder)
    batched = chain.placed()
    return S.set_equality(
        chain.wanted(batched), chain.decisions(batched), ["doc_id", "batch_id"], "case_id"
    )


@query(
    "apply_selections",
    O.with_(*_DECIDED, O.SELECTED)
    + 'SELECT doc_id, start_ AS "start", end_ AS "end", original, replacement, resolution, '
    "case_id, candidate_id FROM selected",
)
def apply_selections(spark: SparkSession, folder: str) -> DataFrame:
    chain = Chain(spark, folder)
    batched = chain.placed()
    decisions = chain.decisions(batched)
    coverage = S.decision_coverage(chain.wanted(batched), decisions)
    return S.apply_selections(batched, coverage, decisions)


@query(
    "apply_patches",
    O.with_(O.TEXTS, O.components_sql(), O.PATCHES, O.rebuilt_sql("patched", "good_patches"))
    + "SELECT r.doc_id, coalesce(v.reason, 'applied') AS outcome, "
    "CASE WHEN v.reason IS NULL THEN preview END AS text "
    "FROM patched r LEFT JOIN patch_verdict v ON v.doc_id = r.doc_id",
)
def apply_patches(spark: SparkSession, folder: str) -> DataFrame:
    texts = transcripts(spark, folder)
    components = stage(spark, folder, "components", lambda: R.merge_components(texts))
    kind = F.col("doc_id") % 11
    patches = components.select(
        "doc_id",
        "start",
        F.when(kind == 2, F.col("end") + 100_000).otherwise(F.col("end")).alias("end"),
        F.when(kind == 1, F.concat("original", F.lit("!"))).otherwise(F.col("original")).alias(
            "original"
        ),
        F.col("merged").alias("replacement"),
        # equal starts: the same patch twice
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
    return V.checked_patches(texts, patches)


@query(
    "seal_gate",
    O.with_(*_REVIEWED, O.rebuilt_sql("sealed", "resolved"))
    + "SELECT s.doc_id, q.items AS review_items, CAST(0 AS BIGINT) AS pending_selection, "
    "q.items = 0 AS sealed, s.preview FROM sealed s JOIN queues q ON q.doc_id = s.doc_id",
)
def seal_gate(spark: SparkSession, folder: str) -> DataFrame:
    chain = Chain(spark, folder)
    items, coverage, batched = chain.reviewed()
    settled = chain.settled(coverage, batched)
    answered = chain.decisions(batched).select("doc_id", "batch_id").distinct()
    pending = batched.where(F.col("batch_id").isNotNull()).join(
        answered, ["doc_id", "batch_id"], "left_anti"
    )
    # a batch without any decision has failed, so its cases wait in review instead
    pending = pending.join(items.select("doc_id", "case_id"), ["doc_id", "case_id"], "left_anti")
    return V.seal_gate(chain.texts, settled, items, pending)


@query(
    "review_queue",
    O.with_(*_REVIEWED)
    + "SELECT q.doc_id, q.status, q.queue_id, i.review_id, i.reason, "
    'i.start_ AS "start", i.end_ AS "end", i.original '
    "FROM queues q LEFT JOIN items i ON i.doc_id = q.doc_id",
)
def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    chain = Chain(spark, folder)
    items, _, _ = chain.reviewed()
    queues = V.review_status(chain.texts, items)
    return queues.join(items, "doc_id", "left").select(
        "doc_id", "status", "queue_id", "review_id", "reason", "start", "end", "original"
    )


@query(
    "review_resolution",
    O.with_(*_REVIEWED, O.HUMAN, O.RESOLUTION)
    + "SELECT v.doc_id, v.outcome, CASE WHEN v.outcome = 'resolved' THEN f.text END AS text "
    "FROM verdict v LEFT JOIN final_text f ON f.doc_id = v.doc_id",
)
def review_resolution(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    chain = Chain(spark, folder)
    items, coverage, batched = chain.reviewed()
    settled = chain.settled(coverage, batched)
    queues = V.review_status(chain.texts, items)
    digit, kind = F.substring("review_id", 10, 1), F.col("doc_id") % 9
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    numbered = items.withColumn("n", F.row_number().over(order)).join(
        queues.select("doc_id", "queue_id"), "doc_id"
    )
    decisions = numbered.where(~((kind == 2) & (F.col("n") == 1))).select(
        "doc_id",
        F.when(kind == 1, "queue_old").otherwise(F.col("queue_id")).alias("queue_id"),
        "review_id",
        F.when((kind == 3) & (F.col("n") == 1), "erase")
        .when(digit < "3", "keep")
        .when(digit < "6", "a")
        .when(digit < "9", "b")
        .when(digit < "c", "peer")
        .otherwise("replace")
        .alias("action"),
        F.when(digit >= "c", "typed by hand").alias("replacement"),
    )
    return V.review_resolution(chain.texts, settled, items, queues, decisions)


@query(
    "merge_plan_audit",
    O.with_(
        O.TEXTS,
        O.components_sql(),
        "fresh AS (SELECT doc_id, start_, end_, original, merged, state FROM components)",
        "stored AS (SELECT doc_id, start_, end_, original, CASE WHEN doc_id % 13 = 5 AND "
        "start_ % 2 = 0 THEN merged || '?' ELSE merged END AS merged, state FROM fresh "
        "WHERE NOT (doc_id % 13 = 6 AND start_ % 5 = 0))",
    )
    + 'SELECT doc_id, start_ AS "start", end_ AS "end", original, merged, state, side FROM ('
    "SELECT *, 'stored' AS side FROM (SELECT * FROM stored EXCEPT ALL SELECT * FROM fresh) "
    "UNION ALL SELECT *, 'recomputed' FROM (SELECT * FROM fresh EXCEPT ALL SELECT * FROM stored))",
)
def merge_plan_audit(spark: SparkSession, folder: str) -> DataFrame:
    texts = transcripts(spark, folder)
    fresh = stage(spark, folder, "components", lambda: R.merge_components(texts)).select(
        "doc_id", "start", "end", "original", "merged", "state"
    )
    kind = F.col("doc_id") % 13
    stored = fresh.where(~((kind == 6) & (F.col("start") % 5 == 0))).withColumn(
        "merged",
        F.when(
            (kind == 5) & (F.col("start") % 2 == 0), F.concat("merged", F.lit("?"))
        ).otherwise(F.col("merged")),
    )
    return V.plan_audit(stored, fresh)


@query(
    "compare_report",
    O.with_(O.TEXTS, *[O.hunks_sql(f"hunks_{v}", v) for v in ("a", "b", "peer")])
    + "SELECT variant, category, count(*) AS hunks, count(DISTINCT doc_id) AS documents, "
    "CAST(sum(length(original)) AS BIGINT) AS base_chars, "
    "CAST(sum(length(replacement)) AS BIGINT) AS variant_chars FROM ("
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variant, h.doc_id, h.original, h.replacement, "
        f"{category_sql('base', v)} AS category FROM hunks_{v} h "
        "JOIN transcripts t ON t.doc_id = h.doc_id"
        for v in ("a", "b", "peer")
    )
    + ") GROUP BY variant, category",
)
def compare_report(spark: SparkSession, folder: str) -> DataFrame:
    texts = transcripts(spark, folder)
    parts = None
    for variant in ("a", "b", "peer"):
        rows = R.categorized(R.diff_hunks(texts, variant, around=True)).select(
            F.lit(variant).alias("variant"), "doc_id", "category", "original", "replacement"
        )
        parts = rows if parts is None else parts.unionByName(rows)
    # per document first, so that the document count needs no distinct over all hunks
    per_doc = parts.groupBy("variant", "category", "doc_id").agg(
        F.count(F.lit(1)).alias("hunks"),
        F.sum(F.length("original")).alias("base_chars"),
        F.sum(F.length("replacement")).alias("variant_chars"),
    )
    return per_doc.groupBy("variant", "category").agg(
        F.sum("hunks").alias("hunks"),
        F.count(F.lit(1)).alias("documents"),
        F.sum("base_chars").alias("base_chars"),
        F.sum("variant_chars").alias("variant_chars"),
    )


def _audit_oracle() -> str:
    digit, batch_digit = "substr(case_id, 6, 1)", "substr(batch_id, 7, 1)"
    return (
        O.with_(*_BATCHED)
        + f"""SELECT doc_id, CASE WHEN {batch_digit} = 'e' THEN batch_id || 'x' ELSE batch_id END
         AS batch_id, case_id, codes FROM (
  SELECT doc_id, batch_id, case_id, concat_ws(',',
    CASE WHEN {batch_digit} = 'e' THEN 'batch_identity' END,
    CASE WHEN {digit} = 'a' THEN 'keep_not_original' END,
    CASE WHEN {digit} = 'b' THEN 'core_interval' END,
    CASE WHEN {digit} = 'c' THEN 'version_target' END,
    CASE WHEN {digit} IN ('c', 'd') THEN 'version_context' END,
    CASE WHEN {batch_digit} = 'f' THEN 'prompt_hash' END) AS codes
  FROM batched WHERE batch_id IS NOT NULL) WHERE codes <> ''"""
    )


@query("selection_batch_audit", _audit_oracle())
def selection_batch_audit(spark: SparkSession, folder: str) -> DataFrame:
    chain = Chain(spark, folder)
    digit, batch_digit = F.substring("case_id", 6, 1), F.substring("batch_id", 7, 1)

    def broken(version):
        return version.withField(
            "target",
            F.when(digit == "c", F.concat(version["target"], F.lit("x"))).otherwise(
                version["target"]
            ),
        ).withField(
            "after",
            F.when(digit == "d", F.concat(version["after"], F.lit("y"))).otherwise(
                version["after"]
            ),
        )

    def judged() -> DataFrame:
        full = S.complete_cases(chain.found()).withColumn("real_end", F.col("end"))
        frozen = full.withColumns({
            "end": F.when(digit == "b", F.col("end") + 1).otherwise(F.col("end")),
            "keep_candidate_id": F.when(digit == "a", "c9").otherwise(F.col("keep_candidate_id")),
            "versions": F.transform("versions", broken),
        })
        return S.judged_cases(frozen).select(
            "doc_id", "case_id", "start", F.col("real_end").alias("end"), "bytes", "own"
        )

    # the cases are judged in the pass that finds them: contexts are neither written nor joined
    cases = stage(spark, folder, "judged", judged)
    numbers = S.batch_ids(S.budget_batches(cases)).drop("bytes")
    batched = cases.join(numbers, CASE_KEYS).where(F.col("batch_id").isNotNull())
    prompt = F.lit("choose one candidate per case")
    stored = batched.select(
        "doc_id",
        F.when(batch_digit == "e", F.concat("batch_id", F.lit("x")))
        .otherwise(F.col("batch_id"))
        .alias("batch_id"),
        "place",
        "case_id",
        "own",
        prompt.alias("prompt"),
        F.concat(
            F.lit("sha256:"),
            F.when(batch_digit == "f", "0").otherwise(F.sha2(prompt, 256)),
        ).alias("prompt_sha256"),
    )
    return S.batch_audit(stored).select(
        "doc_id", "batch_id", "case_id", F.array_join("codes", ",").alias("codes")
    )


QUERIES, ORACLES = registry.queries, registry.oracles
