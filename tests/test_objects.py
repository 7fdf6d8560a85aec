"""The content store: second writes, killed writes, damaged bodies, forged references."""

from pyspark.sql import functions as F

from palimpsest.functions.hashing import content_hash
from palimpsest.sources.objects import ObjectStore


def rows(spark, *texts):
    return spark.createDataFrame([(t, "x") for t in texts], "body string, prefix string")


def test_a_second_write_stores_nothing_and_only_new_contents_follow(spark, tmp_path):
    store = ObjectStore(spark, f"{tmp_path}/s")
    assert store.manifest().count() == store.read().count() == store.audit().count() == 0
    store.write(rows(spark, "a", "b", "b", "", None), "body")
    first = {(r.content_hash, r.batch) for r in store.manifest().collect()}
    assert len(first) == 3
    ObjectStore(spark, f"{tmp_path}/s").write(rows(spark, "b", "a", None), "body")
    assert {(r.content_hash, r.batch) for r in store.manifest().collect()} == first
    assert store.bodies().count() == 3
    store.write(rows(spark, "b", "c" * 100_000, "\u00e9"), "body")
    assert sorted(r.body for r in store.read().collect()) == ["", "a", "b", "c" * 100_000, "\u00e9"]
    assert all(r.intact for r in store.read().collect()) and store.audit().count() == 0
    store.write(rows(spark).limit(0), "body")
    assert store.manifest().count() == 5


def test_half_written_and_damaged_stores_are_found(spark, tmp_path):
    store = ObjectStore(spark, f"{tmp_path}/s")
    store.write(rows(spark, "kept"), "body")
    content = rows(spark, "late").select(
        content_hash(F.col("body")).alias("content_hash"), F.octet_length("body").cast("long").alias("byte_length"), "body"
    ).withColumn("prefix", F.substring("content_hash", 8, 2))
    store.write_bodies(content, "killed")
    assert [r.code for r in store.audit().collect()] == ["unlisted"]
    assert [r.body for r in store.read().collect()] == ["kept"]
    store.write(rows(spark, "late"), "body")
    assert sorted(r.body for r in store.read().collect()) == ["kept", "late"]
    damaged = content.withColumn("body", F.lit("lost"))
    store.write_bodies(damaged, "bad")
    store.commit("bad")
    assert sorted(r.code for r in store.audit().collect()) == ["unlisted", "unlisted"]
    batch = store.write(rows(spark, "third"), "body")
    store.write_bodies(damaged.withColumn("content_hash", F.lit(content_hash_of(spark, "third"))).withColumn("prefix", F.substring("content_hash", 8, 2)), batch)
    assert sorted(r.code for r in store.audit().collect()) == ["corrupt", "unlisted", "unlisted"]
    store.write_bodies(content.limit(0), batch)
    assert sorted(r.code for r in store.audit().collect()) == ["lost", "unlisted", "unlisted"]


def content_hash_of(spark, text):
    return rows(spark, text).select(content_hash(F.col("body")).alias("h")).first().h


def test_references_are_held_against_the_manifest(spark, tmp_path):
    store = ObjectStore(spark, f"{tmp_path}/s")
    store.write(rows(spark, "one", "two"), "body")
    given = spark.createDataFrame(
        [(1, content_hash_of(spark, "one"), 3), (2, content_hash_of(spark, "two"), 4), (3, content_hash_of(spark, "three"), 5),
         (4, None, 3), (5, content_hash_of(spark, "one"), None)],
        "owner long, content_hash string, byte_length long",
    )
    got = {r.owner: r.code for r in store.check(given).collect()}
    assert got == {1: "ok", 2: "length", 3: "missing", 4: "no_content", 5: "length"}
