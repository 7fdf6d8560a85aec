"""From raw documents to tokens: quality, near copies, repeated passages, mixture, encoding.

`STAGES` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the next stage's
documents, with the columns of `documents` (the last one: tokens). Each works on all its predecessor kept.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from palimpsest.functions.materialize import materialize
from palimpsest.llm import automata, bayes_dedup, bpe, mixing, ranking
from palimpsest.llm.queries import vocabulary
from palimpsest.sources.tables import table


#: Bytes of one Arrow batch. Whole texts come in batches, and a worker holds a batch while it cuts it into slices.
BATCH_BYTES = "4m"


def bounded(stage):
    """A stage whose tasks get small batches; the setting stays for the write that runs the stage."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality ranking accepts."""
    model = ranking.train(docs, table(spark, sf_dir, "labels"))
    return ranking.accepted(docs, model)


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies."""
    return bayes_dedup.one_of_each(docs)


@bounded
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that documents of smaller id have too."""
    return automata.dedup(docs)


@bounded
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are left out or repeated as the plan draws them."""
    return mixing.mix(docs)


@bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, ids` of every row: the whole text encoded."""
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_copies),
    ("substring_dedup", passages),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: Learned scores, min-hashes and drawn blocks are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
