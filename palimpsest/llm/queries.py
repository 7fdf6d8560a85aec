"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import functions as F

from palimpsest.functions.materialize import materialize
from palimpsest.llm import automata, bayes_dedup, bpe, crf, density, divergence, fertility, golay, licenses, merkle, mixing, mtree, ranking
from palimpsest.llm.oracles import OP5, OP11, OP13
from palimpsest.plans.registry import Registry
from palimpsest.sources.tables import table

registry = Registry()
query = registry.query
QUERIES, ORACLES = registry.queries, registry.oracles


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, as the installed package knows it."""
    folder = os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


@query("op10_bpe_round_trip")
def op10_bpe_round_trip(spark, folder):
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op3_license_scan")
def op3_license_scan(spark, folder):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return licenses.scan(table(spark, folder, "documents")).select(*columns)


@query("op6_mixing")
def op6_mixing(spark, folder):
    dealt = mixing.dealt(mixing.plan(table(spark, folder, "documents")))
    taken = (F.col("size") * F.size("shards")).alias("taken")
    shards = F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards")
    return dealt.select("doc_id", "size", "source_size", "target", taken, "source", "copies", shards)


@query("op4_pairwise_quality")
def op4_pairwise_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = ranking.train(docs, table(spark, folder, "labels"))
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    predicted = F.when(F.col("score") >= ranking.CUT, 1).otherwise(0).cast("int").alias("predicted")
    return ranking.score(docs, model).select("doc_id", held, "score", predicted)


@query("op5_mtree_top_k", OP5)
def op5_mtree_top_k(spark, folder):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    vectors = materialize(mtree.usable(table(spark, folder, "embeddings"), "vec_id", "embedding", whole))
    return mtree.top_k(vectors, vectors.where(F.col("id") % 50 == 0))


@query("op7_bayes_near_dedup")
def op7_bayes_near_dedup(spark, folder):
    found = bayes_dedup.near_duplicates(table(spark, folder, "documents"))
    first = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))  # a row without an id is never dropped
    return found.select("doc_id", "n_shingles", "component_id", first.alias("kept"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark, folder):
    return automata.digests(table(spark, folder, "documents"))


@query("op1_tokeniser_fertility")
def op1_tokeniser_fertility(spark, folder):
    docs = table(spark, folder, "documents")
    return fertility.judge(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("op8_crf_language")
def op8_crf_language(spark, folder):
    docs = table(spark, folder, "documents")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out")
    return crf.label(docs, crf.train(docs)).select("doc_id", held, "lang_pred", "score")


@query("op9_text_density")
def op9_text_density(spark, folder):
    return density.extract(table(spark, folder, "pages"))


@query("op11_merkle_manifest", OP11)
def op11_merkle_manifest(spark, folder):
    leaves = merkle.documents(table(spark, folder, "documents"))
    return merkle.audit(merkle.manifest(leaves, "lang", ["doc_id"], "leaf"))


@query("op12_golay_simhash")
def op12_golay_simhash(spark, folder):
    return golay.near_duplicates(table(spark, folder, "documents"))


@query("op13_source_divergence", OP13)
def op13_source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))
