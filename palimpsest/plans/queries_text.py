"""Registered text reconcile queries over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.materialize import stage
from palimpsest.operators import reconcile as R
from palimpsest.plans import oracle_text as O
from palimpsest.plans.recipes_text import transcripts
from palimpsest.plans.registry import Registry

registry = Registry()
query = registry.query


@query(
    "text_anchors",
    O.with_(
        O.TEXTS,
        O.gaps_sql("g", "transcripts", [("base", "base"), ("a", "a"), ("b", "b")], ("token",)),
    )
    + "SELECT doc_id, token, CAST(base_pos AS BIGINT) AS base_pos, CAST(a_pos AS BIGINT) AS a_pos,"
    " CAST(b_pos AS BIGINT) AS b_pos FROM g_0_k WHERE token <> ''",
)
def text_anchors(spark: SparkSession, folder: str) -> DataFrame:
    sides = ("base", "a", "b")
    return R.stable_anchors(transcripts(spark, folder), sides, "token")


@query(
    "diff_hunks",
    O.with_(O.TEXTS, O.hunks_sql("hunks", "a"))
    + 'SELECT doc_id, start_ AS "start", end_ AS "end", variant_start, variant_end, original, '
    "replacement FROM hunks",
)
def diff_hunks(spark: SparkSession, folder: str) -> DataFrame:
    return R.diff_hunks(transcripts(spark, folder), "a")


@query(
    "boundary_map",
    O.with_(
        O.TEXTS,
        O.hunks_sql("hunks", "peer"),
        O.components_sql(),
        "positions AS (SELECT doc_id, start_ AS position FROM components UNION ALL "
        "SELECT doc_id, end_ FROM components)",
        O.boundary_sql("mapped", "positions", "hunks"),
    )
    + "SELECT doc_id, position, mapped, mapped_after_insert FROM mapped",
)
def boundary_map(spark: SparkSession, folder: str) -> DataFrame:
    texts = transcripts(spark, folder)
    edges = stage(spark, folder, "components", lambda: R.merge_components(texts)).select(
        "doc_id", F.explode(F.array("start", "end")).alias("position")
    )
    mapped = R.boundary_map(
        edges.distinct(),
        stage(spark, folder, "peer_hunks", lambda: R.diff_hunks(texts, "peer")),
    )
    return mapped.select("doc_id", "position", "mapped", "mapped_after_insert")


@query(
    "merge_components",
    O.with_(O.TEXTS, O.components_sql())
    + 'SELECT doc_id, start_ AS "start", end_ AS "end", original, a_start, a_end, a_text, '
    "b_start, b_end, b_text, state, merged FROM components",
)
def merge_components(spark: SparkSession, folder: str) -> DataFrame:
    return R.merge_components(transcripts(spark, folder))


@query(
    "hunk_category",
    O.with_(O.TEXTS, O.hunks_sql("hunks", "b"))
    + f'SELECT h.doc_id, h.start_ AS "start", h.end_ AS "end", h.original, h.replacement, '
    f"{O.category_sql('base', 'b')} AS category FROM hunks h JOIN transcripts t "
    "ON t.doc_id = h.doc_id",
)
def hunk_category(spark: SparkSession, folder: str) -> DataFrame:
    rows = R.categorized(R.diff_hunks(transcripts(spark, folder), "b", around=True))
    return rows.select("doc_id", "start", "end", "original", "replacement", "category")


@query(
    "reconcile",
    O.with_(
        O.TEXTS,
        O.components_sql(),
        "edits AS (SELECT doc_id, start_, end_, merged AS replacement FROM components)",
        O.rebuilt_sql("rebuilt", "edits"),
        "counts AS (SELECT doc_id, count(*) FILTER (state = 'conflict') AS conflicts, "
        "count(*) FILTER (state = 'singleton') AS singletons, "
        "count(*) FILTER (state = 'agreement') AS agreements FROM components GROUP BY doc_id)",
    )
    + "SELECT r.doc_id, r.preview, coalesce(conflicts, 0) AS conflicts, "
    "coalesce(singletons, 0) AS singletons, coalesce(agreements, 0) AS agreements "
    "FROM rebuilt r LEFT JOIN counts c ON c.doc_id = r.doc_id",
)
def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return R.reconcile(transcripts(spark, folder))


QUERIES, ORACLES = registry.queries, registry.oracles
