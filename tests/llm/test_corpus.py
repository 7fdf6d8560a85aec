"""Operators over many documents: substring and near dedup, mixing, search, components, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import automata, bayes_dedup, mixing, mtree, queries, sieve
from palimpsest.llm.components import components
from tests.llm.helpers import FOLDER, awkward, documents, near_components, without_repeats


# substring dedup


@pytest.mark.parametrize("hot", [400, 1])
def test_removed_words_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(automata, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(automata, "SHARD_WORDS", 3000)
    wanted = without_repeats(documents(spark))
    for r in queries.op2_substring_dedup(spark, FOLDER).collect():
        words, kept = wanted[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (len(words), len(words) - len(kept))
        assert r["kept_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()


def test_short_windows_and_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = without_repeats(rows, 18)
    got = automata.digests(docs, 18).collect()
    assert all(r["n_removed"] == len(wanted[r["doc_id"]][0]) - len(wanted[r["doc_id"]][1]) for r in got)
    odd = awkward(spark)
    cleaned = automata.dedup(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    texts = {(r["doc_id"], r["text"]) for r in cleaned.collect()}
    assert (2, "") in texts and (4, None) in texts and (6, " \t\n ") in texts and (9, "tail of its own") in texts
    assert automata.digests(odd.limit(0)).count() == 0


def test_copies_of_a_form_meet_one_row(spark):
    rng = random.Random(6)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(4)]
    # one document a passage, then copies of a text that holds them all: several hits a form
    rows = [(i, p) for i, p in enumerate(passages)] + [(i, " ".join(passages)) for i in range(10, 40)]
    spans = automata.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), 18)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Relation \[anchor#\d+L?,content#\d+L?,hits#\d+\]", plan) and "Generate" not in plan
    covered = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"]} for r in spans.collect()}
    assert set(covered) == set(range(10, 40)) and all((0, 120) in covered[i] or len(covered[i]) >= 4 for i in covered)


def test_a_text_that_repeats_itself_is_a_row_a_different_segment(spark):
    rng = random.Random(8)
    lines = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(7)) for _ in range(3)]
    rows = [(1, "the end " * 300), (2, "own words " + "the end " * 280), (3, "so it is " * 100), (4, " ".join(lines * 40)), (5, None)]
    rows += [(i, f"start{i} " + " ".join(lines * 30) + " the end" * 90) for i in range(6, 12)] + [(12, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = automata.segments(docs).collect()
    assert len({(r["doc_id"], r["anchor"], r["content"]) for r in found}) == len(found) < 300
    words = {i: len((t or "").split()) for i, t in rows}
    windows = Counter()
    for r in found:
        assert r["starts"] == sorted(set(r["starts"]))
        windows[r["doc_id"]] += r["number"] * len(r["starts"])
    assert windows == Counter({i: n - 49 for i, n in words.items() if n > 49})
    wanted = without_repeats(rows)
    for r in automata.digests(docs).collect():
        full, kept = wanted[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (len(full), len(full) - len(kept))
        assert r["kept_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()


def test_automaton_knows_the_smallest_owner():
    rng = random.Random(9)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(5, 40))] for _ in range(30)]
    owners = [rng.randrange(50) for _ in sequences]
    machine = automata.Automaton(sequences, owners)
    for s in sequences + [[rng.randrange(4) for _ in range(30)]]:
        wanted = []
        for i in range(len(s) - 4):
            holders = [o for t, o in zip(sequences, owners, strict=True) if any(t[k : k + 5] == s[i : i + 5] for k in range(len(t) - 4))]
            wanted.append(min(holders, default=None))
        assert machine.lowest(s, 5) == wanted


# near dedup


def test_components_equal_brute_force(spark):
    wanted = near_components(documents(spark))
    got = queries.op7_bayes_near_dedup(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_groups_and_awkward_rows(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows, text = [], list(base)
    for i in range(60):  # a chain of copies that drift, and a star around the first
        star = list(base)
        for _ in range(rng.randrange(4)):
            star[rng.randrange(150)] = rng.choice(vocabulary)
        text = list(text)
        text[rng.randrange(150)] = rng.choice(vocabulary)
        rows += [(1000 + i, " ".join(text)), (2000 + i, " ".join(star)), (3000 + i, " ".join(rng.choice(vocabulary) for _ in range(100)))]
    rows += [(4000, "a b"), (4001, "A b"), (4002, None), (4003, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in bayes_dedup.near_duplicates(docs).collect()}
    assert got == near_components(rows)
    odd = awkward(spark)
    kept = bayes_dedup.one_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 10}
    assert bayes_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_near_copies_without_ids_stay(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "a", 1), (5, text, "en", "a", 1), (3, text, None, None, 1), (None, "of its own " * 9, "en", "a", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_bayes_near_dedup(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter(
        [(3, 3, True), (5, 3, False), (None, 3, True), (None, None, True), (None, None, True)]
    )
    left = bayes_dedup.one_of_each(docs).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["3", "None", "None", "None"]


def test_pruning_bound_is_the_posterior():
    for n, t in ((40, 0.75), (128, 0.875)):
        m = bayes_dedup.least_equal(n, t, 1e-3)
        grid = np.linspace(0, 1, 200_001)[1:-1]

        def tail(k, n=n, t=t, grid=grid):
            log = k * np.log(grid) + (n - k) * np.log(1 - grid)
            w = np.exp(log - log.max())
            return w[grid >= t].sum() / w.sum()

        assert tail(m) >= 1e-3 * 0.99 and tail(m - 1) < 1e-3 * 1.01


def test_component_labels(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(70)] + [(1000, j) for j in range(1001, 1200)]
    edges += [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sieve_never_loses_an_id(spark):
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    rows = spark.range(4000).withColumnRenamed("id", "n")
    marked = sieve.maybe(rows, F.col("n"), sieve.sieve(ids, "k"))
    assert marked.where("n % 7 = 0 and n < 3000 and not `~maybe`").count() == 0
    left = {r["n"] for r in sieve.without(rows, F.col("n"), ids, "k").collect()}
    assert left == {n for n in range(4000) if n % 7 or n >= 3000}


# mixing


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_mix_comes_near_its_targets(spark, folder):
    rows = queries.op6_mixing(spark, folder).collect()
    texts = dict(documents(spark, folder))
    assert len(rows) == len(texts)
    sources = sorted({r["source"] for r in rows})
    amount = {s: sum(len((texts[r["doc_id"]] or "").encode().split()) for r in rows if r["source"] == s) for s in sources}
    weight = dict(zip(sources, [5, 2, 1] * len(sources), strict=False))
    target, free, left = {}, set(sources), 1.5 * sum(amount.values())
    while free:
        wanted = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if wanted[s] > 2 * amount[s]]
        if not above:
            target |= wanted
            break
        for s in above:
            target[s] = 2.0 * amount[s]
            left -= target[s]
            free.discard(s)
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode().split()) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == amount[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sources:
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - target[s]) <= max(20, 0.01 * target[s])
    again = {(r["doc_id"], r["taken"]) for r in queries.op6_mixing(spark, folder).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_splitting_tree_keeps_quotas():
    quotas = np.array([100, 7, 0, 33])
    split = mixing.splitting_tree(quotas, 8, np.random.default_rng(3))
    assert (split.sum(axis=1) == quotas).all() and (split >= 0).all()
    assert split.sum(axis=0).max() - split.sum(axis=0).min() <= 1
    assert list(mixing.targets(np.array([10, 10, 0]), np.array([5.0, 2.0, 1.0]), 1.5, 2.0)) == [20.0, 10.0, 0.0]


def test_taken_words_are_those_dealt_to_shards(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op6_mixing(spark, folder).collect()
    for r in rows:
        shards = [int(s) for s in r["shards"].split(",") if s]
        assert len(shards) == r["copies"] and r["taken"] == len(shards) * r["size"] and all(0 <= s < mixing.SHARDS for s in shards)
    made = mixing.plan(spark.read.parquet(f"{folder}/documents.parquet"))
    drawn = {(b["sid"], b["block"], b["copy"]): b["shard"] for b in made.blocks.collect()}
    place = {r["doc_id"]: (r["sid"], r["block"]) for r in made.rows.collect()}
    for r in rows:
        assert r["shards"] == ",".join(str(drawn[*place[r["doc_id"]], k + 1]) for k in range(r["copies"]))
    none = made.blocks.where("copy = 0")
    lost = mixing.dealt(mixing.Mix(made.rows, made.sources, made.counts, made.filled, none))
    assert lost.count() == len(rows) and lost.where("size(shards) > 0").count() == 0  # without dealt blocks nothing is taken


def test_open_blocks_hold_few_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_ROWS", 50)
    rows = [(i, "word", "a") for i in range(1000)] + [(2000 + i, None if i % 2 else " ", "a") for i in range(1000)]
    rows += [(5000 + i, "some more words " * 20, "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    choices = {"weights": (7, 2), "share": 1.43}
    made = mixing.plan(docs, **choices)
    filled = made.filled.collect()
    assert filled and all(r["size"] > 0 for r in filled) and sum(r["source"] == "a" for r in filled) <= 100
    wanted = {r["doc_id"]: r["copies"] for r in made.rows.collect()}
    assert len(wanted) == len(rows)
    for source in made.sources.collect():
        got = sum(r["size"] * r["copies"] for r in made.rows.where(F.col("source") == source["name"]).collect())
        assert abs(got - source["target"]) <= 60
    got = {r["doc_id"]: r["count"] for r in mixing.mix(docs, **choices).groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in wanted.items() if c} and any(i in got for i in range(2000, 3000))
    assert all(r["copies"] == len(r["shards"]) for r in mixing.dealt(made).collect())


def test_mixed_rows_follow_the_plan(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("sid", F.lit("own")).withColumn("size", F.lit(0))
    wanted = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).rows.collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in wanted.items() if c}
    odd = awkward(spark)
    assert mixing.plan(odd).rows.count() == odd.count()
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.plan(odd.limit(0)).rows.count() == 0


def test_mixed_rows_of_repeated_ids(spark):
    rows = [(i % 40 if i % 3 else None, f"{'word ' * (i % 7)}{i % 5}", "ab"[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    size = {r: len((r[1] or "").split()) for r in rows}
    wanted = Counter()
    for r in mixing.plan(docs).rows.collect():
        wanted[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], size[tuple(r)]) for r in mixing.mix(docs).collect())
    assert got == +wanted
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs).collect()))


# search


def test_search_equals_the_oracle(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    wanted = database.execute(queries.ORACLES["op5_mtree_top_k"]).fetchall()
    got = [tuple(r) for r in queries.op5_mtree_top_k(spark, FOLDER).collect()]
    assert sorted(got) == sorted(wanted)


def plain_top(rows, k):
    out = []
    for q, v in rows:
        found = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("size", [40, 3])
def test_search_with_ties_clusters_and_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "SAMPLE_ROWS", 10)
    rng = np.random.default_rng(size)
    rows = [(i, rng.integers(-3, 4, 4).tolist()) for i in range(size)] + [(1000 + i, [1, 2, 3, 4]) for i in range(size)]
    rows += [(5000, [7, 7]), (5001, [1, 1])]
    frame = spark.createDataFrame(rows, "id long, vec array<long>")
    monkeypatch.setattr(mtree, "BLOCK_ROWS", 16)
    assert sorted(tuple(r) for r in mtree.top_k(frame, frame, 4).collect()) == sorted(plain_top(rows, 4))


def test_vectors_that_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, None]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0]), (6, [0.5, -0.001]), (6, [0.5, -0.001])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = F.transform("embedding", lambda x: F.floor(x * 256).cast("long"))
    used = mtree.usable(frame, "vec_id", "embedding", whole)
    assert [tuple(r) for r in used.collect()] == [(6, [128, -1])]
    assert mtree.top_k(used, used).count() == 0
    assert mtree.top_k(used.limit(0), used.limit(0)).count() == 0


def test_best_first_search_skips_distances():
    rng = np.random.default_rng(2)
    centers = rng.integers(-200, 200, (30, 16))
    vectors = np.repeat(centers, 60, axis=0) + rng.integers(-4, 5, (1800, 16))
    tree = mtree.Tree(np.arange(1800), vectors)
    best, computed = tree.search(vectors[7], 7, 5, -np.inf)
    scores = vectors @ vectors[7]
    order = sorted((-int(s), i) for i, s in enumerate(scores) if i != 7)[:5]
    assert best == [(-s, i) for s, i in order] and computed < 1800


def test_queries_of_a_block_meet_a_page_once(monkeypatch):
    """Results are those of each query alone, ties and its own id included; work per page, not per query and page."""
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(np.vstack([rng.integers(-5, 6, (500, 6)), np.full((200, 6), 2), np.zeros((3, 6), int)]))]
    vectors = np.array([v for _, v in rows])
    tree, calls, real = mtree.Tree(np.arange(len(rows)), vectors), [], mtree.products
    monkeypatch.setattr(mtree, "products", lambda left, right: calls.append(1) or real(left, right))
    own = np.arange(0, len(rows), 3)
    at, ids, scores, _ = tree.search_block(vectors[own], own, 4, np.full(len(own), -np.inf))
    found = [(int(own[a]), n % 4 + 1, i, s) for n, (a, i, s) in enumerate(zip(at.tolist(), ids.tolist(), scores.tolist(), strict=True))]
    assert found == [r for r in plain_top(rows, 4) if r[0] % 3 == 0] and len(calls) <= len(tree.pages)


# pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Every stage but the learned and drawn ones against a plain version of it, on what it was given."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, given = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, given, FOLDER)
        rows, before = made.collect(), [(r["doc_id"], r["text"]) for r in given.collect()]
        if name == "bpe":
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in before)
            break
        assert made.columns == columns
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in rows}
            trained = [i for i, _ in before if i in labels and zlib.crc32(str(i).encode()) % 5]
            assert all((i in kept) == (labels[i] == 1) for i in trained)
        if name == "near_dedup":
            assert {r["doc_id"] for r in rows} == {i for i, (_, c) in near_components(before).items() if i == c}
        if name == "substring_dedup":
            wanted = without_repeats(before)
            assert all((r["text"] or "").encode().split() == wanted[r["doc_id"]][1] for r in rows) and len(rows) == len(before)
            assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
        given = spark.createDataFrame(rows, made.schema)
    assert corpus_pipeline.run(spark, FOLDER).count() == len(rows)
